"""Scoring of texts by a probabilistic suffix tree over bytes, with a word-count score beside it.

The tree predicts each byte of a lower-cased text, and its end, from the longest kept suffix of the
bytes before it (up to ``DEPTH``).

1. Count: every run of DEPTH + 1 bytes of the training texts, per block in numpy, summed by Spark.
2. Test: shorter contexts are sums of longer ones. A context is kept if it is frequent (at least
   ``CONTEXT_SHARE`` of all bytes) and its next bytes diverge from those after its own suffix: the
   log-likelihood gain must exceed ``COST`` per distinct next byte. Suffixes of kept contexts are kept.
3. Smooth: a kept context holds back a mass for what it has not seen (as often as it has seen
   something new) and hands it to its suffix, down to the uniform distribution.
4. Score: each block looks up its distinct runs once; a text's score is the sum over its bytes.

The counts cover all training texts and grow with them. The kept tree does not: by the pigeonhole
principle at most 1 / CONTEXT_SHARE contexts per depth and 1 / PAIR_SHARE (context, byte) pairs per
depth can reach their shares, whatever the corpus is. Hence it may be collected and broadcast.

Word counts are exact for all words. Frequent words (at most 1 / WORD_SHARE of them, by the same
argument) are broadcast; all others go through a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.batches import cut
from shelfspark.session import checkpointed

DEPTH = 6
BITS = 9
END = 256
SYMBOLS = 257
CONTEXT_SHARE = 2.0**-20
PAIR_SHARE = 2.0**-22
WORD_SHARE = 2.0**-21
COST = 2.0
BLOCK = 3 << 20
PIECE = 1 << 20
EXTRA = 0.1


def low(bits: int) -> int:
    return (1 << bits) - 1


def blocks(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(runs, where each piece begins, text of each piece). A run packs depth + 1 symbols, the last is predicted.

    Before its first byte a text is preceded by END. Long texts are cut into pieces that overlap by
    their context, so memory is bounded.
    """
    parts, lengths, owners, size = [], [], [], 0
    opening, ending = np.full(depth, END, np.uint16), np.full(1, END, np.uint16)

    def packed():
        symbols = np.concatenate(parts).astype(np.int64)
        key = np.zeros(len(symbols) - depth, np.int64)
        for i in range(depth + 1):
            key = key << BITS | symbols[i : i + len(key)]
        # Runs that reach over the end of a piece are none.
        spans = np.array(lengths)
        whole = np.ones(len(key), bool)
        whole[(np.cumsum(spans)[:-1, None] - depth + np.arange(depth)).ravel()] = False
        return key[whole], np.cumsum([0, *(spans - depth)[:-1]]), np.array(owners)

    for owner, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8).astype(np.uint16)
        for start in range(0, max(len(data), 1), PIECE):
            last = start + PIECE >= len(data)
            context = opening if start == 0 else data[start - depth : start]
            piece = [context, data[start : start + PIECE], *([ending] if last else [])]
            parts += piece
            lengths.append(sum(map(len, piece)))
            owners.append(owner)
            size += lengths[-1]
            if size >= BLOCK:
                yield packed()
                parts, lengths, owners, size = [], [], [], 0
    if parts:
        yield packed()


def distinct(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds in order, how often each occurs, places of the runs in that order)."""
    order = np.argsort(runs)
    ranked = runs[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))[: len(runs)]
    return ranked[first], np.diff(first, append=len(runs)), order


def lowered(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes with A-Z in lower case; null is empty."""
    return [x or b"" for x in pc.ascii_lower(pc.fill_null(column, "")).cast(pa.binary()).to_pylist()]


def count_runs(texts: DataFrame, depth: int) -> DataFrame:
    """run, n over the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 0):
            for runs, _, _ in blocks(lowered(batch.column(0)), depth):
                runs.sort()
                first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(runs[first]), pa.array(np.diff(first, append=len(runs)))], ["run", "n"])

    return texts.select("text").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


@dataclass
class SuffixTree:
    """Kept contexts and pairs by depth: sorted keys with log10 of what is handed down and of the probability."""

    depth: int
    contexts: list[np.ndarray] = field(default_factory=list)
    handed: list[np.ndarray] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)

    def look_up(self, runs: np.ndarray, deepest: int | None = None) -> np.ndarray:
        """log10 probability of the last symbol of each run after the symbols before it."""
        out, open_runs = np.zeros(len(runs)), np.arange(len(runs))
        for d in range(self.depth if deepest is None else deepest, -1, -1):
            key = runs[open_runs]
            pair = key & low(BITS * (d + 1))
            at, known = find(self.pairs[d], pair)
            out[open_runs[known]] += self.logs[d][at[known]]
            rest = ~known
            at, kept = find(self.contexts[d], pair[rest] >> BITS)
            open_runs = open_runs[rest]
            out[open_runs[kept]] += self.handed[d][at[kept]]
        out[open_runs] -= np.log10(SYMBOLS)
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def grow(counts: DataFrame, total: int, depth: int, context_share: float, pair_share: float, cost: float) -> SuffixTree:
    """The tree of ``counts`` (run, n), whose n sum up to ``total``."""
    fewest, fewest_pair = context_share * total, pair_share * total
    # Counts of all depths at once: a run gives its suffixes.
    suffixes = [F.struct(F.lit(d).alias("d"), F.col("run").bitwiseAND(low(BITS * (d + 1))).alias("pair")) for d in range(depth + 1)]
    levels = counts.select(F.explode(F.array(*suffixes)).alias("s"), "n").groupBy("s.d", "s.pair").agg(F.sum("n").alias("n"))
    split = levels.select("d", F.shiftright("pair", BITS).alias("context"), F.col("pair").bitwiseAND(low(BITS)).alias("symbol"), "n")
    nodes = checkpointed(split.groupBy("d", "context").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"),
        F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("next"),  # at most SYMBOLS entries
    ).filter(F.col("total") >= fewest))
    shorter = F.expr(f"context & (shiftleft(1L, {BITS} * (d - 1)) - 1)")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("context").alias("suffix"), F.col("total").alias("total2"), F.col("next").alias("next2"))
    gain = F.expr("aggregate(map_entries(next), 0D, (s, e) -> s + e.value * (ln(e.value / total) - ln(try_element_at(next2, e.key) / total2)))")
    diverging = nodes.filter("d > 0").withColumn("suffix", shorter).join(above, ["d", "suffix"]).filter(gain > cost * F.col("kinds"))
    closed = [F.struct(F.lit(d).alias("d"), F.col("context").bitwiseAND(low(BITS * d)).alias("context")) for d in range(depth + 1)]
    kept = diverging.select(F.explode(F.slice(F.array(*closed), 1, F.col("d") + 1)).alias("k")).select("k.*")
    kept = kept.union(nodes.filter("d = 0").select("d", "context")).distinct()
    frequent = F.map_filter("next", lambda _, n: n >= fewest_pair)
    rows = nodes.join(kept, ["d", "context"]).select("d", "context", "total", "kinds", frequent.alias("next"))
    # Bounded: see the pigeonhole argument above.
    held = rows.select("d", "context", "total", "kinds", F.map_keys("next").alias("s"), F.map_values("next").alias("n")).toArrow()
    tree = SuffixTree(depth)
    for d in range(depth + 1):
        smooth(tree, d, held.filter(pc.equal(held.column("d"), d)))
    return tree


def smooth(tree: SuffixTree, d: int, held: pa.Table) -> None:
    """Add depth ``d`` to a tree that has all smaller depths."""
    context = held.column("context").to_numpy()
    symbols, n = held.column("s").combine_chunks(), held.column("n").combine_chunks()
    sizes = np.diff(symbols.offsets.to_numpy()) if len(context) else np.zeros(0, np.int64)
    symbol, seen = symbols.flatten().to_numpy().astype(np.int64), n.flatten().to_numpy().astype(float)
    owner = np.repeat(np.arange(len(context)), sizes)
    whole = held.column("total").to_numpy().astype(float) + held.column("kinds").to_numpy()
    handed = whole - np.bincount(owner, weights=seen, minlength=len(context)) if len(context) else whole
    pair = context[owner] << BITS | symbol if len(context) else np.zeros(0, np.int64)
    below = 10 ** tree.look_up(pair, d - 1) if d else np.full(len(pair), 1 / SYMBOLS)
    logs = np.log10((seen + handed[owner] * below) / whole[owner])
    order, order2 = np.argsort(context), np.argsort(pair)
    tree.contexts.append(context[order])
    tree.handed.append(np.log10(handed / whole)[order])
    tree.pairs.append(pair[order2])
    tree.logs.append(logs[order2])


def held_out(key: Column) -> Column:
    """Rows that are scored only; a null key is learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text of each word, and the words: runs of other than ASCII blanks, A-Z in lower case."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    owner = np.repeat(np.arange(len(column)), np.diff(parts.offsets.to_numpy()))
    words = parts.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    return owner[filled.to_numpy(zero_copy_only=False)], words.filter(filled)


def count_words(texts: DataFrame) -> DataFrame:
    """word, c over the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 0):
            found = pc.value_counts(tokens_of(batch.column(0))[1])
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def score_texts(
    docs: DataFrame, depth: int = DEPTH, context_share: float = CONTEXT_SHARE, pair_share: float = PAIR_SHARE,
    cost: float = COST, word_share: float = WORD_SHARE, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learnt from rows that are not held out, in all their copies. Null texts are empty: one token, the
    end. Without training rows the tree is uniform and the base score 0. Repeated keys are rows of their
    own. Texts are scored whole, however long; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    train = rows.filter(~F.col("held_out"))
    symbols = train.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    tree = grow(count_runs(train, depth), symbols, depth, context_share, pair_share, cost)
    counts = checkpointed(count_words(train))
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = train.count()
    n, v = words + ends, kinds + (ends > 0)
    scale = n + EXTRA * (v + 1)
    # At most 1 / word_share words.
    head = counts.filter(F.col("c") >= word_share * max(n, 1)).toArrow()
    head_words = pa.array(head.column("word").combine_chunks())
    # Plain values, as tasks need not have this package.
    model = spark.sparkContext.broadcast((vars(tree), head_words, head.column("c").to_numpy()))
    end_log = float(np.log10((ends + EXTRA) / scale))
    key_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {key_type}, held_out boolean, n_tokens long, n_known long, base double, score double, word string, n long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, head_words, head_counts = model.value
        tree = SuffixTree(**kept)
        logs = np.log10((head_counts + EXTRA) / scale)
        for batch in cut(batches, 3):
            size, rows, texts = batch.num_rows, batch.column(0), batch.column(3)
            scores, offset = np.zeros(size), 0
            for runs, begins, owners in blocks(lowered(texts), tree.depth):
                # In order, neighbours are searched in the same places of the tree.
                found, often, order = distinct(runs)
                logs_of = np.empty(len(runs))
                logs_of[order] = np.repeat(tree.look_up(found), often)
                sums = np.add.reduceat(logs_of, begins)
                scores += np.bincount(owners, weights=sums, minlength=size)
            owner, tokens = tokens_of(texts)
            coded = tokens.dictionary_encode()
            code = coded.indices.to_numpy()
            at = pc.index_in(coded.dictionary, value_set=head_words).fill_null(-1).to_numpy(zero_copy_only=False)[code] if len(code) else code
            known = at >= 0
            base = np.bincount(owner[known], weights=logs[at[known]], minlength=size) + end_log
            n_known = np.bincount(owner[known], minlength=size) + int(ends > 0)
            n_tokens = np.bincount(owner, minlength=size) + 1
            # Rows of texts carry a word that no text has, so that they spread over the join.
            marks = pc.binary_join_element_wise(pa.array([" "] * size), rows.cast(pa.string()), "")
            none = pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(1), batch.column(2), *map(pa.array, (n_tokens, n_known, base, scores)), marks, none], names
            )
            # Other words: (row, word, how often).
            rest = (owner[~known].astype(np.int64) << 32) | code[~known]
            pairs, often = np.unique(rest, return_counts=True)
            row = rows.take(pa.array(pairs >> 32))
            word = coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF))
            nulls = [pa.nulls(len(pairs), kind) for kind in (batch.schema.field(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([row, *nulls, word, pa.array(often)], names)

    names = [f.split()[0] for f in schema.split(", ")]
    parts = rows.mapInArrow(score, schema)
    joined = parts.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(c > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.max("base") + F.coalesce(F.sum(F.col("n") * F.log10((c + EXTRA) / scale)), F.lit(0.0))).alias("base_score"),
        F.max("score").alias("score"),
    ).drop("row")
