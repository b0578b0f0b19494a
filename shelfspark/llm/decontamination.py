"""Benchmark decontamination with an FM-index per shard of training texts.

Training rows are cut into shards of whole texts of about ``batches.BYTES`` bytes. Each shard is indexed:
its words, numbered by the words of the benchmark, are one sequence with a break at the end of each text
and wherever words lie that no benchmark item has. All windows of the benchmark are searched backwards in
the index, their places are found from sampled suffix positions, and overlapping places are merged to
removal spans. Texts are not shuffled, and a shard needs memory in proportion to its own size only.

The windows of the benchmark go to the tasks in blocks of at most about ``BLOCK`` pairs of window and item,
whatever its size; each further block is one more pass over the texts, whose result so far is written to
the checkpoint folder. Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.batches import cut
from shelfspark.llm.fm_index import FMIndex
from shelfspark.session import checkpointed

WINDOW = 10
BLOCK = 200_000
# What each byte becomes: A-Z lowered, other ASCII characters than letters and digits blank.
BYTE_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SPANS = "array<struct<start:long,length:long>>"


def plain_texts(column: pa.Array) -> pa.Array:
    """Texts with A-Z lowered and blanks in place of all that is no part of a word; null is empty."""
    texts = pc.fill_null(column.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    blank = data.to_pybytes().translate(BYTE_TABLE) if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(blank), offset=texts.offset)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of plain texts one after the other, and where each text begins (and ends)."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words = parts.flatten()
    ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    # A text without words is split into one empty word.
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    return words.filter(pa.array(filled)), np.concatenate(([0], np.cumsum(filled)))[ends]


def benchmark_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """item (as text), words: every window of every item once."""
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            words, ends = split_words(plain_texts(batch.column(1)))
            words = words.to_pylist()
            for name, start, stop in zip(names, ends[:-1].tolist(), ends[1:].tolist()):
                found = [words[i : i + window] for i in range(start, max(start + 1, stop - window + 1))] if stop > start else []
                found = [w[: stop - start] for w in found]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.list_(pa.string()))], ["item", "words"])

    return rows.mapInArrow(run, "item string, words array<string>").distinct()


@dataclass
class Phrases:
    """One block of windows: words, windows as rows of word numbers from 1 (filled up on the left), items of each."""

    words: pa.Array
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, table: pa.Table, window: int) -> Phrases:
        items: dict[tuple, list[str]] = {}
        for name, words in zip(table.column("item").to_pylist(), table.column("words").to_pylist()):
            listed = items.setdefault(tuple(words), [])
            if name is not None:
                listed.append(name)
        numbers = {w: i + 1 for i, w in enumerate(sorted({w for words in items for w in words}))}
        rows = np.array([[0] * (window - len(words)) + [numbers[w] for w in words] for words in items], np.int64)
        return cls(pa.array(list(numbers), pa.string()), rows, np.array([len(w) for w in items]), list(items.values()))


def known_runs(symbols: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence to be indexed, and the place among all words of each of its symbols.

    Runs of known words of one text, each with a break (0) after it. Runs too short for any window are left out.
    """
    inside = np.zeros(len(symbols) + 1, np.int64)
    inside[: len(symbols)] = symbols > 0
    edges = np.zeros(len(symbols) + 1, bool)
    edges[ends] = True
    before = np.concatenate(([0], inside[:-1]))
    starts = np.flatnonzero((inside == 1) & ((before == 0) | edges))
    stops = np.flatnonzero((before == 1) & ((inside == 0) | edges))
    long = stops - starts >= shortest
    starts, sizes = starts[long], (stops - starts)[long]
    # A run and the place behind it, which becomes the break.
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes + 1)[:-1])), sizes + 1) if len(sizes) else np.zeros(0, np.int64)
    places = np.arange(len(shift)) + shift
    sequence = symbols[np.minimum(places, len(symbols) - 1)] if len(places) else places
    if len(sizes):
        sequence[np.cumsum(sizes + 1) - 1] = 0
    return sequence, places


def search_shard(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
    """Number of words of each text, and for texts with hits their merged spans (start, length) and items."""
    words, ends = split_words(texts)
    coded = words.dictionary_encode()
    numbers = pc.fill_null(pc.add(pc.index_in(coded.dictionary, phrases.words), 1), 0).to_numpy(zero_copy_only=False)
    symbols = numbers.astype(np.int64)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    sequence, places = known_runs(symbols, ends, int(phrases.lengths.min()))
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    if len(sequence):
        kinds = len(phrases.words) + 1
        index = FMIndex(sequence, kinds)
        # Only windows all of whose words occur in the shard are searched.
        there = index.counts > 0
        there[0] = True
        asked = np.flatnonzero(there[phrases.rows].all(axis=1))
        if len(asked):
            low, high = index.ranges(phrases.rows[asked], phrases.lengths[asked])
            sizes = high - low
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
            phrase = np.repeat(asked, sizes)
            start = places[index.locate(rows)]
            order = np.argsort(start, kind="stable")
            start, phrase = start[order], phrase[order]
            text = np.searchsorted(ends, start, side="right") - 1
            for first, stop in zip(*group_edges(text)):
                begin = start[first:stop] - ends[text[first]]
                spans = merged(list(zip(begin.tolist(), phrases.lengths[phrase[first:stop]].tolist())))
                out[int(text[first])] = spans, set().union(*[phrases.items[p] for p in np.unique(phrase[first:stop])])
    return np.diff(ends), out


def group_edges(values: np.ndarray) -> tuple[list[int], list[int]]:
    """First places of equal neighbours, and the places after their last."""
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return (edges[:-1], edges[1:]) if len(values) else ([], [])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, length) in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return [(a, b) for a, b in out]


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id",
    block: int = BLOCK, keep_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (start, length), items; with ``keep_text`` also text.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    ``spans`` are the merged places of windows in the text, counted in words from 0, ``items`` the ids (as
    text, each once, in order) of the items with a window in it. Null texts have no words, nor have empty
    ones; both give a row without spans. Repeated rows and ids are searched each on its own. Texts are
    searched whole, however long: a text longer than a shard is a shard. An item with a null id adds
    spans but no id. Without items, or without documents, nothing is found. Other columns are not read.
    """
    windows = checkpointed(benchmark_windows(items, item, text, window))
    n = windows.count()
    blocks = max(1, -(-n // block))
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {key_type}, text string, n_words long, spans {SPANS}, items array<string>"
    names = [part.split(" ")[0] for part in ("doc_id", "text", "n_words", "spans", "items")]
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    number = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for i in range(blocks):
        phrases = Phrases.of(windows.filter(number == i).toArrow(), window)

        def run(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases, last: bool = i == blocks - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plain = plain_texts(batch.column(1))
                for part in cut([pa.RecordBatch.from_arrays([*batch.columns, plain], [*names, "plain"])], 5):
                    if len(phrases.lengths):
                        counts, found = search_shard(part.column(5), phrases)
                    else:
                        counts, found = np.diff(split_words(part.column(5))[1]), {}
                    spans, listed = part.column(3), part.column(4)
                    if found:
                        spans, listed = spans.to_pylist(), listed.to_pylist()
                        for at, (new, ids) in found.items():
                            spans[at] = [{"start": a, "length": b} for a, b in merged([*((s["start"], s["length"]) for s in spans[at]), *new])]
                            listed[at] = sorted({*listed[at], *ids})
                        spans, listed = pa.array(spans, span_type), pa.array(listed, pa.list_(pa.string()))
                    # The text itself is needed by a further pass only.
                    kept = part.column(1) if keep_text or not last else pa.nulls(part.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), kept, pa.array(counts, pa.int64()), spans, listed], names)

        rows = rows.mapInArrow(run, schema)
        if i < blocks - 1:
            rows = checkpointed(rows)
    return rows if keep_text else rows.drop("text")


def digests(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words in spans), n_items, items_sha256 (of the sorted ids), contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return leaks.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean_texts(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, text, n_words, spans, items: texts without the spans, a blank in the place of each.

    A span goes from the first character of its first word to the last of its last. Texts without spans
    stay as they are, also null ones; a text may become empty.
    """
    leaks = find_leaks(docs, items, keep_text=True, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            texts = [without(t, s) if s else t for t, s in zip(texts, spans)]
            yield batch.set_column(1, "text", pa.array(texts, pa.string()))

    return leaks.mapInArrow(run, leaks.schema)


def without(text: str, spans: list[dict]) -> str:
    """A text without spans of words."""
    blank = np.frombuffer(text.encode().translate(BYTE_TABLE), np.uint8) == 32
    inside = np.concatenate(([False], ~blank, [False]))
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    raw, out, at = text.encode(), [], 0
    for span in spans:
        out.append(raw[at : starts[span["start"]]])
        at = int(stops[span["start"] + span["length"] - 1])
    return b" ".join([*out, raw[at:]]).decode()


def leaks_sql(window: int = WINDOW) -> str:
    """The digests in DuckDB SQL over the tables ``documents`` and ``benchmark``."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(text, '{alphabet}', '{alphabet.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({words}, []) AS words FROM documents),
b AS (SELECT item_id, {words} AS words FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, least(len(words), {window}) AS size,
  unnest(list_transform(range(1, greatest(2, len(words) - {window} + 2)), lambda i: array_to_string(words[i : i + {window} - 1], ' '))) AS win
  FROM b WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM w),
p AS (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM d, sizes),
h AS (SELECT row, pos, p.size, item_id FROM p JOIN w ON w.size = p.size AND w.win = array_to_string(p.words[pos : pos + p.size - 1], ' ')),
n AS (SELECT row, count(DISTINCT hit) AS n_hit FROM (SELECT row, unnest(range(pos, pos + size)) AS hit FROM h) GROUP BY row),
i AS (SELECT row, count(DISTINCT item_id) AS n_items, coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '') AS ids FROM h GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN i USING (row)
"""
