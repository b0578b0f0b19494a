"""Mixing to target weights by budgets that flow down a domain-language-source tree.

1. The tokens of each leaf (domain, language, source) are summed; a leaf can give its tokens at most
   ``max_epochs`` times, a node what its leaves can give.
2. The token budget enters at the root. A node shares its budget among its children by weight; a
   child that cannot take its share is filled, and its shortage goes to its siblings. Only what all
   children together cannot take is missing at the node, and as capacities are summed upwards first,
   the node's own siblings have taken it by then. Sorting children by capacity per weight makes
   this one running sum instead of a loop. Shares are whole tokens, rounded down.
3. A leaf repeats its documents for as many whole epochs as its budget holds. Of the next epoch it
   takes the prefix, in the order of a seeded hash, whose tokens fit into the rest.

The order of a leaf is never sorted as a whole: tokens are summed per (leaf, leading hash digits),
which tells the group of documents where the prefix ends; all groups before it are taken, and only
that one is sorted. A leaf with a third of all rows is thus spread over tasks like any other.
Everything is DataFrame code. The texts are read once and are not shuffled; what follows works on
keys. The table of leaves is broadcast only if it was counted and is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import checkpointed

LEVELS = ["domain", "lang", "source"]
# Leading hex digits of the hash that make a group of a leaf's order.
DIGITS = 4
DOMAINS = 4
MAX_BROADCAST_LEAVES = 50_000

# Target weights (whole numbers). What is not listed has OTHER.
WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 3},
}
OTHER = 1


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Sources are dealt to ``DOMAINS`` domains by the number in their name (0 if there is none)."""
    digits = F.right(F.regexp_replace(F.coalesce(source, F.lit("")), "[^0-9]", ""), F.lit(9))
    return F.concat(F.lit("d"), (F.coalesce(digits.try_cast("int"), F.lit(0)) % DOMAINS).cast("string"))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(OTHER)
    for value, weight in weights.items():
        out = F.when(name == value, weight).otherwise(out)
    return out.cast("long")


def same(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of columns of two aliased tables."""
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return on


def share_among_children(children: DataFrame, parent: list[str], level: str, weights: dict[str, int]) -> DataFrame:
    """``budget`` of each child from the ``whole`` budget of its parent and its own ``cap``.

    Children in the order of capacity per weight: those that their share fills come first, and each
    of them leaves less budget and less weight for the rest.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    children = children.withColumn("weight", weight_of(F.col(level), weights))
    order = siblings.orderBy(F.col("cap") / F.col("weight"), level)
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    children = children.withColumn("rest", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    open_weight = F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    children = children.withColumn("open", open_weight).withColumn("full", F.expr("cap * open <= weight * rest"))
    left = F.first(F.when(~F.col("full"), F.struct("rest", "open")), ignorenulls=True).over(upto)
    children = children.withColumn("left", left)
    budget = F.when(F.col("left").isNull(), F.col("cap")).otherwise(F.expr("weight * left.rest div left.open"))
    return children.withColumn("budget", budget).drop("weight", "rest", "open", "full", "left", "whole", "cap")


def leaf_budgets(leaves: DataFrame, percent: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``leaves`` (LEVELS and tokens, one row each) with the ``budget`` of each."""
    caps = [leaves.select(*LEVELS, (F.col("tokens") * max_epochs).alias("cap"))]
    for depth in (2, 1):
        caps.insert(0, caps[0].groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    root = caps[0].agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap")).join(total)
    root = root.select(F.least("cap", F.expr(f"total * {percent} div 100")).alias("whole"))
    nodes = share_among_children(caps[0].join(root), [], LEVELS[0], weights[LEVELS[0]])
    for depth in (2, 3):
        parent = LEVELS[: depth - 1]
        whole = caps[depth - 1].alias("c").join(nodes.alias("p"), same("c", "p", parent))
        whole = whole.select("c.*", F.col("p.budget").alias("whole"))
        nodes = share_among_children(whole, parent, LEVELS[depth - 1], weights[LEVELS[depth - 1]])
    return leaves.alias("l").join(nodes.alias("n"), same("l", "n", LEVELS)).select("l.*", "n.budget")


def choose(
    docs: DataFrame, percent: int = 50, max_epochs: int = 4, seed: int = 17,
    weights: dict[str, dict[str, int]] = WEIGHTS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """What is taken: key (as ``doc_id``), ``digest`` (MD5 of the text), LEVELS, ``n_tokens``, ``n_rows``, ``copies``.

    The budget is ``percent`` of all tokens (may be over 100). ``copies`` is 1 to ``max_epochs``; what
    is not taken has no row. Null language or source are names of their own, null and empty texts have
    no tokens and come with the prefix that they fall into. Rows with equal key, language, source and
    text are one (``n_rows`` tells how many): they are taken or left together. Equal keys with different
    texts are different documents. Words of a text are counted whole, however long it is; an empty table
    gives no rows. Extra columns are not read.
    """
    rows = docs.select(
        domain_of(F.col("source")).alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source"),
        F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        word_count(F.col(text)).alias("n_tokens"),
    )
    units = rows.groupBy("doc_id", "digest", *LEVELS).agg(F.first("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
    units = checkpointed(units.withColumn("tokens", F.col("n_tokens") * F.col("n_rows")))
    leaves = units.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = leaf_budgets(checkpointed(leaves), percent, max_epochs, weights)
    leaves = checkpointed(leaves.select(
        *LEVELS, F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget div tokens END").alias("epochs"),
        F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END").alias("rest"),
    ))
    small = leaves.count() <= MAX_BROADCAST_LEAVES
    hint = F.broadcast if small else lambda df: df
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("l.epochs").cast("string"), F.coalesce(F.col("u.doc_id").cast("string"), F.lit(""))))
    ordered = units.alias("u").join(hint(leaves).alias("l"), same("u", "l", LEVELS)).select("u.*", "l.epochs", "l.rest", order.alias("place"))
    ordered = ordered.withColumn("start", F.left("place", F.lit(DIGITS)))

    groups = ordered.groupBy(*LEVELS, "start").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    over = groups.withColumn("sum", F.sum("tokens").over(upto)).filter("sum > rest")
    cut = over.groupBy(*LEVELS).agg(F.min_by(F.struct("start", (F.col("rest") - F.col("sum") + F.col("tokens")).alias("rest")), "start").alias("cut"))
    placed = ordered.drop("rest").alias("o").join(hint(cut).alias("c"), same("o", "c", LEVELS), "left").select("o.*", "c.cut")
    placed = placed.withColumn("side", F.expr("CASE WHEN cut IS NULL OR start < cut.start THEN 1 WHEN start = cut.start THEN 0 ELSE -1 END"))
    running = Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("side = 0").withColumn("taken", (F.sum("tokens").over(running) <= F.col("cut.rest")).cast("int"))
    others = placed.filter("side <> 0").withColumn("taken", (F.col("side") > 0).cast("int"))
    copies = F.col("epochs") + F.when(F.col("epochs") < max_epochs, F.col("taken")).otherwise(0)
    taken = others.unionByName(edge).withColumn("copies", copies.cast("int")).filter("copies > 0")
    return taken.select("doc_id", "digest", *LEVELS, "n_tokens", "n_rows", "copies")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``choose`` takes, each as often as it is taken. Columns stay as they are.

    Nulls, empty texts, repeated rows and empty tables as in ``choose``: repeated rows are taken together, each
    of them as often as their copies say. Columns may have any names.
    """
    taken = choose(docs, key=key, text=text, **options)
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in ("doc_id", "digest", "lang", "source", "copies")])
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        F.col("lang").alias("lang"), F.col("source").alias("source"),
    )
    on = F.expr("doc_id <=> t_doc_id AND digest = t_digest AND lang <=> t_lang AND source <=> t_source")
    repeated = rows.join(taken, on).select("row", F.explode(F.sequence(F.lit(1), F.col("t_copies"))).alias("copy"))
    return repeated.select("row.*")


def choose_sql(percent: int = 50, max_epochs: int = 4, seed: int = 17, weights: dict[str, dict[str, int]] = WEIGHTS) -> str:
    """``choose`` in DuckDB SQL over the table ``documents``."""
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights[level].items())
        return f"CASE {level} {cases} ELSE {OTHER} END"

    def level(depth: int, source: str) -> str:
        path, parent, name = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]), LEVELS[depth - 1]
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
w{depth} AS (SELECT {path}, sum(tokens)::BIGINT * {max_epochs} AS cap, any_value(whole) AS whole, any_value({weight(name)}) AS weight
  FROM {source} GROUP BY {path}),
s{depth} AS (SELECT *, whole - coalesce(sum(cap) OVER b, 0)::BIGINT AS rest,
  (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER b, 0))::BIGINT AS open FROM w{depth}
  WINDOW b AS ({by} ORDER BY cap / weight, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{depth} AS (SELECT *, first(CASE WHEN cap * open > weight * rest THEN rest END IGNORE NULLS) OVER u AS lrest,
  first(CASE WHEN cap * open > weight * rest THEN open END IGNORE NULLS) OVER u AS lopen FROM s{depth}
  WINDOW u AS ({by} ORDER BY cap / weight, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b{depth} AS (SELECT {path}, CASE WHEN lrest IS NULL THEN cap ELSE weight * lrest // lopen END AS whole FROM f{depth}),
"""

    def join(depth: int) -> str:
        on = " AND ".join(f"l.{n} IS NOT DISTINCT FROM b.{n}" for n in LEVELS[:depth])
        return f"(SELECT l.*, b.whole FROM leaves l JOIN b{depth} b ON {on})"

    return rf"""
WITH rows AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, lang, source,
  'd' || (coalesce(try_cast(right(regexp_replace(coalesce(source, ''), '[^0-9]', '', 'g'), 9) AS INT), 0) % {DOMAINS}) AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
units AS (SELECT doc_id, digest, domain, lang, source, any_value(n_tokens) AS n_tokens, count(*) AS n_rows FROM rows GROUP BY ALL),
leaves AS (SELECT domain, lang, source, sum(n_tokens * n_rows)::BIGINT AS tokens FROM units GROUP BY ALL),
total AS (SELECT least(sum(tokens)::BIGINT * {max_epochs}, sum(tokens)::BIGINT * {percent} // 100) AS whole FROM leaves),
{level(1, "(SELECT l.*, whole FROM leaves l, total)")}{level(2, join(1))}{level(3, join(2))}
plan AS (SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE whole // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE whole % tokens END AS rest FROM {join(3)}),
placed AS (SELECT u.*, epochs, rest, sum(u.n_tokens * u.n_rows) OVER (PARTITION BY u.domain, u.lang, u.source
  ORDER BY md5('{seed}:' || epochs || ':' || coalesce(u.doc_id::VARCHAR, '')), u.doc_id NULLS FIRST, u.digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM units u JOIN plan p ON u.domain = p.domain AND u.lang IS NOT DISTINCT FROM p.lang AND u.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, digest, domain, lang, source, n_tokens, n_rows, (epochs + CASE WHEN epochs < {max_epochs} AND run <= rest THEN 1 ELSE 0 END)::INT AS copies
FROM placed WHERE copies > 0
"""
