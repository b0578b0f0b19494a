"""Link graph of a catalog, groups of links and items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.frames import map_rows
from shelfspark.operators.ordered import number_rows, ordered
from shelfspark.session import Appended, written


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that can be reached from the start nodes. edges: src, dst; start: node. Loops are fine.

    One round per level; a round joins the newest level only and adds what is new to the table of all
    levels, so a node is written once. Edges are made once.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    seen = Appended(start.select("node"), "reached")
    seen.add(start.select("node").distinct())
    while not seen.latest().isEmpty():
        found = edges.join(seen.latest(), edges.src == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        seen.add(found.join(seen.read().select("node"), "node", "left_anti"))
    return seen.read().select("node")


def broken_links(links: DataFrame, targets: DataFrame, sources: DataFrame, first_only: bool = False) -> DataFrame:
    """Links on reachable sources whose target does not exist.

    links: src, pos, href (as a target path); targets: node; sources: node (reachable ones).
    ``first_only`` looks at the first link of each source.
    """
    live = links.join(sources.withColumnRenamed("node", "src"), "src", "left_semi")
    if first_only:
        live = live.groupBy("src").agg(F.min(F.struct("pos", "href")).alias("l")).select("src", "l.*")
    return live.join(targets.withColumnRenamed("node", "href"), "href", "left_anti")


def group_by_keys(rows: DataFrame, keys: str, outer: bool = True) -> DataFrame:
    """One row per (element, key) of a multi-valued key column; elements without key get a null key."""
    explode = F.explode_outer if outer else F.explode
    return rows.withColumn("key", explode(F.array_distinct(F.col(keys)))).drop(keys)


# Entries of one feed that are decided together in one task.
BLOCK_ENTRIES = 4096


def _read_blocks(links: Iterator[tuple]) -> Iterator[tuple]:
    """Entries of blocks in order: the groups that each may choose, one if it is decided.

    Rows are (feed, block, pos, row, rank, group, first, sure, maybe), sorted by the first five: was the group surely, or
    perhaps, opened before this position by entries that are read elsewhere. In the first block of a feed nothing before
    it is open. Only what the entries of one block open is held.
    """
    read, place, sure, maybe, same = None, None, set(), set(), []
    for (feed, block, pos, row), entry in groupby(links, key=lambda l: (l.feed, l.block, l.pos, l.row)):
        entry = list(entry)
        if read != (feed, block):
            read, place, sure, maybe, same = (feed, block), pos, set(), set(), []
        # Entries at one position do not see each other.
        elif pos != place and not (pos != pos and place != place):
            for options in same:
                (sure if len(options) == 1 else maybe).update(options)
            place, same = pos, []
        options = []
        for link in entry:
            if link.group is not None and (link.sure or link.group in sure):
                options.append(link.group)
                break
            if link.group is not None and (link.group in maybe or (link.maybe and not link.first)):
                options.append(link.group)
        else:
            options.append(entry[0].group)
        options = list(dict.fromkeys(options))
        same.append([g for g in options if g is not None] if len(options) == 1 else options)
        yield row, feed, pos, [l.group for l in entry], options


def choose_groups(entries: DataFrame, block: int = BLOCK_ENTRIES) -> DataFrame:
    """Group of each feed entry: the first of its group links that an earlier entry opened, else its first.

    entries: feed, pos, links (array of group addresses, may be empty). Out: feed, pos, group.
    The choice of an entry depends on earlier choices. In each round the open entries are cut in blocks of
    their feed, which are read in order side by side. What other blocks open is known between bounds: the
    first position where a decided entry has a group, and the first where an open one may have it. Entries
    whose choice is the same for all that lies between are decided; of each feed the first block always is.
    """
    first = F.try_element_at("links", F.lit(1))
    kinds = {c: entries.schema[c].dataType.simpleString() for c in ("feed", "pos", "links")}
    rows = written(entries.select(F.monotonically_increasing_id().alias("row"), "feed", "pos", "links"), "entries")
    # A null feed or position is before or behind no other entry.
    several = F.coalesce(F.size("links") > 1, F.lit(False)) & F.col("feed").isNotNull() & F.col("pos").isNotNull()
    plain = rows.filter(~several).select("feed", "pos", first.alias("group"))
    opened = lambda df, sure: df.select("feed", "group", (F.col("pos") if sure else F.lit(None).cast(kinds["pos"])).alias("sure"), F.col("pos").alias("maybe"))
    merged = lambda df: df.filter("group is not null").groupBy("feed", "group").agg(F.min("sure").alias("sure"), F.min("maybe").alias("maybe"))
    active = rows.filter(several)
    decided = Appended(plain, "decided")
    decided.add(plain)
    bounds = merged(opened(plain, True).union(opened(active.select("feed", "pos", F.explode("links").alias("group")), False)))
    while not active.isEmpty():
        bounds = written(bounds, "bounds")
        numbered = number_rows(ordered(active, ["feed"], [F.col("pos"), F.col("row")]), "n").plain()
        number = F.floor((F.col("n") - 1) / block).alias("block")
        links = numbered.select("row", "feed", "pos", number, F.posexplode("links").alias("rank", "group"))
        known = links.join(bounds, ["feed", "group"], "left").select(
            "feed", "block", "pos", "row", "rank", "group", (F.col("block") == 0).alias("first"),
            F.coalesce(F.col("sure") < F.col("pos"), F.lit(False)).alias("sure"), F.coalesce(F.col("maybe") < F.col("pos"), F.lit(False)).alias("maybe"),
        )
        schema = f"row long, feed {kinds['feed']}, pos {kinds['pos']}, links {kinds['links']}, options {kinds['links']}"
        # A task reads many blocks one after the other: most feeds are small, and a call per feed would cost more than its work.
        sorted_links = known.repartition("feed", "block").sortWithinPartitions("feed", "block", "pos", "row", "rank")
        step = written(map_rows(sorted_links, _read_blocks, schema), "step")
        done = step.filter(F.size("options") == 1).select("feed", "pos", F.element_at("options", 1).alias("group"))
        decided.add(done)
        active = step.filter(F.size("options") > 1).select("row", "feed", "pos", "links")
        options = step.filter(F.size("options") > 1).select("feed", "pos", F.explode("options").alias("group"))
        before = bounds.filter("sure is not null").select("feed", "group", "sure", F.col("sure").alias("maybe"))
        bounds = merged(before.union(opened(done, True)).union(opened(options, False)))
    return decided.read().select("feed", "pos", "group")
