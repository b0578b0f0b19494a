"""Conversation structure repair: faults, cheapest edits by an auction, repaired messages.

Messages are range-partitioned by conversation and turn, so a conversation may be spread over many tasks,
and cut into runs of at most ``RUN`` messages of one conversation. Each run is a lattice that
``auction_paths`` solves. A conversation of several runs is put together by a tree: the table of costs from
each entry to each exit state of a run composes with that of the next one, ``FAN_IN`` at a time; the cost of
all that follows is handed down again, each run is solved with it, and the states at which runs are entered
are found by a second such tree. No task holds a conversation, but for the two values that the digests ask
of it as a whole (its edits as one text, one hash over its messages), which are made in one pass over its runs.

Texts are moved twice: into order, and to their edits. All else works on one letter per message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfspark.llm.auction_paths import ACCEPTED, NEVER, STATES, auction, placed, transfer
from shelfspark.operators.ordered import number_rows, ordered
from shelfspark.session import checkpointed, shuffle_partitions, written

RUN, FAN_IN = 64, 64
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def runs_of(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, run, turns, roles, texts, codes, marks: runs of messages in order.

    ``run`` grows along a conversation. A code is the role initial (x for any other than s, u, a), in upper
    case if the text is cut short, and - if it is blank. A mark is a digest of role and text.
    """
    role, text = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    short = ~F.substring(ended, -1, 1).isin(".", "!", "?")
    code = F.when(ended == "", "-").when(short, F.upper(letter)).otherwise(letter)
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("*", code.alias("code"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("mark"))
    # Equal messages are spread by an arbitrary last key.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ["conv", F.asc_nulls_first("turn"), "role", "mark", "tie"]
    ranged = rows.repartitionByRange(shuffle_partitions(messages.sparkSession), *order).sortWithinPartitions(*order).drop("tie")
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            convs = batch.column(0)
            # A null conversation is one, too.
            same = convs.dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh = np.flatnonzero(np.diff(same)) + 1
            edges = [0]
            for stop in [*fresh.tolist(), n]:
                edges.extend(range(edges[-1] + RUN, stop, RUN))
                edges.append(stop)
            offsets = pa.array(edges, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in range(1, 6)]
            numbers = pa.array(range(number, number + len(edges) - 1), pa.int64())
            number += len(edges) - 1
            yield pa.RecordBatch.from_arrays([convs.take(pa.array(edges[:-1])), numbers, *lists], ["conv", "run", "turns", "roles", "texts", "codes", "marks"])

    schema = f"conv {kinds['conv']}, run long, turns array<{kinds['turn']}>, roles array<string>, texts array<string>, codes array<string>, marks array<string>"
    return written(ranged.select("conv", "turn", "role", "text", "code", "mark").mapInArrow(run, schema), "runs")


def with_duplicates(runs: DataFrame) -> DataFrame:
    """conv (as a struct, so that nulls are equal), run, codes: = marks a message that is not blank and whose role and text occur earlier."""
    narrow = runs.select(F.struct("conv").alias("conv"), "run", F.posexplode("marks").alias("at", "mark"))
    seen = number_rows(ordered(narrow, ["conv", "mark"], [F.col("run"), F.col("at")]), "nth").plain().filter("nth > 1")
    again = seen.groupBy("run").agg(F.collect_set("at").alias("again"))
    marked = F.transform("codes", lambda c, i: F.when((c != "-") & F.array_contains(F.coalesce("again", F.array().cast("array<int>")), i), "=").otherwise(c))
    joined = runs.select(F.struct("conv").alias("conv"), "run", "codes", "roles").join(again, "run", "left")
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1))
    return joined.select("conv", "run", F.array_join(marked, "").alias("codes"), initials.alias("initials"))


def tree_states(table: DataFrame, compose: Callable, hand: Callable, start: list[int], backward: bool) -> DataFrame:
    """conv, idx, state: the state at the near end of each element (conv, idx from 0, value) of a chain.

    ``compose(first, second)`` joins neighbouring values, ``hand(value, state)`` carries a state over one. A chain is
    followed from ``start`` at its first element, or, ``backward``, from its last one. ``FAN_IN`` neighbours at a
    time are held together; the levels of the tree are written to the checkpoint folder.
    """
    longest = table.agg(F.max("idx")).first()[0]
    levels, size = [], (longest or 0) + 1
    level = table

    def composed(children: pd.Series) -> pd.Series:
        out = []
        for parts in children:
            values = [list(p["value"]) for p in parts]
            total = values[0]
            for value in values[1:]:
                total = compose(total, value)
            out.append(total)
        return pd.Series(out, dtype=object)

    def handed(children: pd.Series, states: pd.Series) -> pd.Series:
        out = []
        for parts, state in zip(children, states):
            state, found = list(state), []
            for p in reversed(parts) if backward else parts:
                found.append({"idx": p["idx"], "state": state})
                state = hand(list(p["value"]), state)
            out.append(found)
        return pd.Series(out, dtype=object)

    while True:
        children = F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("children")
        groups = checkpointed(level.groupBy("conv", F.floor(F.col("idx") / FAN_IN).alias("idx")).agg(children))
        levels.append(groups)
        size = -(-size // FAN_IN)
        if size == 1:
            break
        level = groups.select("conv", "idx", F.pandas_udf(composed, "array<long>")("children").alias("value"))
    down = F.pandas_udf(handed, "array<struct<idx:long,state:array<long>>>")
    state = None
    for groups in reversed(levels):
        if state is None:
            known = groups.withColumn("state", F.array(*[F.lit(s).cast("long") for s in start]))
        else:
            known = groups.join(state, ["conv", "idx"])
        state = known.select("conv", F.explode(down("children", "state")).alias("x")).select("conv", "x.*")
    return state


def joined_costs(first: list[int], second: list[int]) -> list[int]:
    return [min(NEVER, *(first[STATES * a + b] + second[STATES * b + c] for b in range(STATES))) for a in range(STATES) for c in range(STATES)]


def costs_before(costs: list[int], after: list[int]) -> list[int]:
    return [min(NEVER, *(costs[STATES * a + b] + after[b] for b in range(STATES))) for a in range(STATES)]


SOLVED = "struct<cost:long,exits:array<long>,labels:array<string>>"


def solve(codes: pd.Series, tails: pd.Series, final: pd.Series) -> pd.DataFrame:
    """For each entry state of a run: its exit state and labels; ``cost`` is that of the first entry."""
    out = []
    for code, tail, last in zip(codes, tails, final):
        found = [auction(code, entry, list(tail), bool(last)) for entry in range(STATES)]
        out.append({"cost": found[0][0] if found[0] else None, "exits": [f[1] if f else 0 for f in found], "labels": [f[2] if f else None for f in found]})
    return pd.DataFrame(out, columns=["cost", "exits", "labels"])


def transfers(codes: pd.Series, final: pd.Series) -> pd.Series:
    return pd.Series([transfer(code, bool(last)) for code, last in zip(codes, final)], dtype=object)


def solve_whole(codes: pd.Series) -> pd.DataFrame:
    """The same for runs that are conversations: entered in the first state only."""
    found = [auction(code, 0, ACCEPTED) for code in codes]
    return pd.DataFrame({"cost": [f[0] for f in found], "labels": [f[2] for f in found]})


def edits_of(runs: DataFrame) -> DataFrame:
    """conv, run, codes, runs (of the conversation), entry, labels, cost (in the first run, of the whole conversation)."""
    sizes = runs.groupBy("conv").agg(F.count(F.lit(1)).alias("runs"))
    counted = checkpointed(runs.select("conv", "run", "codes").join(sizes, "conv"))
    whole = counted.filter("runs = 1").withColumn("x", F.pandas_udf(solve_whole, "cost long, labels string")("codes"))
    whole = whole.select("conv", "run", "codes", "runs", F.lit(0).alias("entry"), "x.labels", "x.cost")
    parts = counted.filter("runs > 1")
    if parts.isEmpty():
        return whole
    numbered = number_rows(ordered(parts, ["conv"], [F.col("run")]), "nth").plain()
    parts = numbered.withColumn("idx", F.col("nth") - 1).withColumn("final", F.col("nth") == F.col("runs")).drop("nth")
    tables = parts.select("conv", "idx", F.pandas_udf(transfers, "array<long>")("codes", "final").alias("value"))
    tails = tree_states(tables, joined_costs, costs_before, ACCEPTED, backward=True)
    known = parts.join(tails.withColumnRenamed("state", "tails"), ["conv", "idx"])
    solved = checkpointed(known.withColumn("x", F.pandas_udf(solve, SOLVED)("codes", "tails", "final")))
    ways = solved.select("conv", "idx", F.col("x.exits").alias("value"))
    entries = tree_states(ways, lambda f, g: [g[q] for q in f], lambda f, s: [f[s[0]]], [0], backward=False)
    entered = solved.join(entries, ["conv", "idx"]).withColumn("entry", F.element_at("state", 1).cast("int"))
    labels = F.element_at("x.labels", F.col("entry") + 1).alias("labels")
    cost = F.when(F.col("idx") == 0, F.col("x.cost")).alias("cost")
    return whole.union(entered.select("conv", "run", "codes", "runs", "entry", labels, cost))


def repaired_runs(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, run, runs, labels, messages: the repaired messages (turn, role, text, edit) of each run.

    ``edit`` is the label K, R or I; an inserted message has the turn null and an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            made, offsets = {"turn": [], "role": [], "text": [], "edit": []}, [0]

            def add(turn, role, text, edit, made=made) -> None:
                for name, value in zip(made, (turn, role, text, edit)):
                    made[name].append(value)

            def insert(initials: str) -> None:
                for initial in initials:
                    add(None, "user" if initial == "u" else "assistant", "", "I")

            for codes, entry, labels, turns, roles, texts in zip(*(rows[c] for c in ("codes", "entry", "labels", "turns", "roles", "texts"))):
                before, changed, behind = placed(labels, entry, codes)
                for initials, new, turn, role, text in zip(before, changed, turns, roles, texts):
                    insert(initials)
                    if new is not None:
                        add(turn, new or role, text, "R" if new else "K")
                insert(behind)
                offsets.append(len(made["role"]))
            columns = [pa.array(made[n], kind) for n, kind in zip(made, (turn_arrow, pa.string(), pa.string(), pa.string()))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, list(made)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv", "run", "runs", "labels")), lists], ["conv", "run", "runs", "labels", "messages"])

    kinds = {f.name: f.dataType for f in runs.schema}
    turn_type, turn_arrow = kinds["turns"].elementType.simpleString(), to_arrow_type(kinds["turns"].elementType)
    joined = runs.select("conv", "run", "turns", "roles", "texts").join(edits.drop("conv", "cost"), "run")
    message = f"struct<turn:{turn_type},role:string,text:string,edit:string>"
    return joined.mapInArrow(run, f"conv {kinds['conv'].simpleString()}, run long, runs long, labels string, messages array<{message}>")


def faults(marked: DataFrame) -> DataFrame:
    """conv, blank, duplicate, truncated, illegal: counts of the messages' first faults and of adjacent initials out of turn."""
    codes = F.col("codes")
    count = lambda pattern: F.length(codes) - F.length(F.regexp_replace(codes, pattern, ""))
    pairs = F.zip_with(F.slice("initials", 2, RUN), F.slice("initials", 1, F.size("initials") - 1), lambda b, a: ~F.concat(a, b).isin(*LEGAL))
    inner = F.size(F.filter(pairs, lambda bad: bad))
    parts = marked.groupBy("conv").agg(
        F.sum(count("-")).alias("blank"), F.sum(count("=")).alias("duplicate"), F.sum(count("[SUAX]")).alias("truncated"),
        F.sum(inner).alias("inner"), F.count(F.lit(1)).alias("runs"),
    )
    # Where two runs meet: only conversations of several runs have such places.
    ends = marked.join(parts.filter("runs > 1").select("conv"), "conv").select(
        "conv", "run", F.element_at("initials", 1).alias("first"), F.element_at("initials", -1).alias("last")
    )
    numbered = number_rows(ordered(ends, ["conv"], [F.col("run")]), "nth").plain()
    after = numbered.select("conv", (F.col("nth") - 1).alias("nth"), F.col("first").alias("next"))
    met = numbered.join(after, ["conv", "nth"]).filter(~F.concat("last", "next").isin(*LEGAL))
    between = met.groupBy("conv").agg(F.count(F.lit(1)).alias("between"))
    total = (F.col("inner") + F.coalesce("between", F.lit(0))).cast("long").alias("illegal")
    longs = [F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    return parts.join(between, "conv", "left").select("conv", *longs, total)


def gaps(messages: DataFrame, conv: str, turn: str) -> DataFrame:
    """conv, gaps: turns that lie between the first and the last one but do not occur."""
    turns = messages.groupBy(F.struct(F.col(conv).alias("conv")).alias("conv"), F.col(turn).alias("turn")).agg(F.count(F.lit(1)).alias("n"))
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


class Repair:
    """Repair of a table of messages.

    Messages of a conversation are taken by turn, nulls first, then role, then a digest of role and text;
    a null role or text is one space, a null conversation is one. Repeated rows are messages of their own, hence
    duplicates. Every conversation with a message has a report; one whose messages all go has no
    messages left. Empty tables give empty results. Texts are read whole, however long. Other columns
    are not read. Turns must be integers.
    """

    def __init__(self, messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.conv = conv
        self.runs = runs_of(messages, conv, turn, role, text)
        marked = checkpointed(with_duplicates(self.runs))
        # Both blank messages and duplicates must go.
        self.edits = checkpointed(edits_of(marked.withColumn("codes", F.translate("codes", "=", "-"))))
        self.faults, self.gaps = faults(marked), gaps(messages, conv, turn)
        self.repaired = repaired_runs(self.runs, self.edits)

    def messages(self) -> DataFrame:
        """conv_id, place (growing along a conversation), turn, role, text, edit of the repaired messages."""
        rows = self.repaired.select(F.col("conv").alias(self.conv), "run", F.posexplode("messages").alias("at", "m"))
        return rows.select(self.conv, F.struct("run", "at").alias("place"), "m.*")

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
        cost = self.edits.groupBy("conv").agg(F.max("cost").alias("cost"))
        line = lambda m: F.concat(m["role"], F.lit(":"), m["text"])
        texts = self.repaired.select(
            F.struct("conv").alias("conv"), "run", "runs", "labels", F.when(F.size("messages") > 0, F.array_join(F.transform("messages", line), "\n")).alias("text")
        )
        whole = texts.filter("runs = 1").select("conv", F.col("labels").alias("audit"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
        several = texts.filter("runs > 1").select("conv", "run", "labels", "text").repartition("conv").sortWithinPartitions("conv", "run")
        kind = several.schema["conv"].dataType.simpleString()
        found = whole.union(several.mapInArrow(put_together, f"conv {kind}, audit string, repaired_sha256 string"))
        rows = self.faults.join(self.gaps, "conv").join(cost, "conv").join(found, "conv")
        return rows.select(F.col("conv.conv").alias(self.conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, audit and digest of conversations whose runs come in order, one run at a time."""
    kind, now, state = None, None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array(["".join(state[0])]), pa.array([state[1].hexdigest()])], ["conv", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.column(0).type
        for conv, labels, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if state is None or conv != now:
                if state is not None:
                    yield closed()
                now, state = conv, ([], hashlib.sha256(), [False])
            state[0].append(labels)
            if text is not None:
                state[1].update((("\n" if state[2][0] else "") + text).encode())
                state[2][0] = True
    if state is not None:
        yield closed()


def damage(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The messages with faults made by a hash of conversation and turn, to try a repair on.

    Of 20 values, one drops a message, one empties its text, one takes its full stops, exclamation and
    question marks, one repeats it, one makes it a user's. Nulls are one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    rows = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(shown(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text)).alias("text"), kind.alias("kind"),
    ).filter("kind <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_damaged(messages: DataFrame) -> DataFrame:
    """The report of the damaged messages for every conversation of ``messages``; zeros and empty texts where nothing is left."""
    report = Repair(damage(messages)).report()
    known = messages.select(F.struct(F.col("conv_id")).alias("c")).distinct()
    found = known.join(report.withColumn("r", F.struct("conv_id")), F.col("c") == F.col("r"), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(F.col("c.conv_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def repair_sql() -> str:
    """The reports of ``repair_damaged`` in DuckDB SQL over the table ``conversations``.

    Messages are read one by one. For each state the best way so far is a text: its cost in nine digits, the
    edits, character 1, and the repaired messages, each behind character 2; the least text is the best way.
    """
    def add(way: str, cost: str, label: str, line: str | None) -> str:
        total = f"lpad((left({way}, 9)::INT + {cost})::VARCHAR, 9, '0')"
        lines = f"split_part({way}, chr(1), 2)" + (f" || chr(2) || {line}" if line else "")
        return f"{total} || split_part(substr({way}, 10), chr(1), 1) || '{label}' || chr(1) || {lines}"

    insert = lambda way, role: add(way, "2", "I", f"'{role}:'")
    closed = lambda rows: f"""SELECT conv_id, i, s0, s1, v2 AS s2, least(s3, {insert('v2', 'assistant')}) AS s3 FROM (
      SELECT conv_id, i, s0, s1, s3, least(s2, {insert('s0', 'user')}, {insert('s1', 'user')}, {insert('s3', 'user')}) AS v2 FROM ({rows}))"""
    stays, new = "role || ':' || text", lambda role: f"'{role}:' || text"
    keep = lambda way, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(way, 'cut', 'K', stays)} END"
    turned = lambda way, role: f"CASE WHEN NOT gone THEN {add(way, '2 + cut', 'R', new(role))} END"
    drop = lambda way: add(way, "3", "D", None)
    users = ", ".join(f"{keep(s, 'u')}, {turned(s, 'user')}" for s in ("s0", "s1", "s3"))
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM o) WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS nth,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain FROM d),
m AS (SELECT *, left(role, 1) AS initial, plain = '' AS blank, plain <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 AS again FROM n),
f AS (SELECT *, blank OR again AS gone, (NOT blank AND NOT again AND right(plain, 1) NOT IN ('.', '!', '?'))::INT AS cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) || initial AS pair FROM m),
w AS ({closed("SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM f")}
  UNION ALL {closed(f'''SELECT f.conv_id, nth AS i, {drop('s0')} AS s0, least({drop('s1')}, {keep('s0', 's')}) AS s1, least({drop('s2')}, {users}) AS s2,
    least({drop('s3')}, {keep('s2', 'a')}, {turned('s2', 'assistant')}) AS s3 FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.nth = w.i + 1''')}),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS size, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    sum(cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
b AS (SELECT c.*, least(s0, s3) AS best FROM c JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.size)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost,
  coalesce(split_part(substr(best, 10), chr(1), 1), '') AS audit,
  sha256(coalesce(replace(substr(split_part(best, chr(1), 2), 2), chr(2), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
"""
