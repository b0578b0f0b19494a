"""Encoding and decoding with a given byte-pair vocabulary, by a contiguous rank array.

A word is held as an array of parts and an array of the ranks of neighbouring parts. The smallest
rank is searched, its boundary is deleted and the two ranks beside it are looked up again, until no
neighbours can be merged. For short words this is faster than a heap. Words above ``LONG_WORD``
parts, where it would take quadratic time, use a heap over linked parts with the same result.

The vocabulary file is of fixed size; it is read once by the driver and broadcast. Texts are encoded
where they lie: there is no shuffle. Words that were met before come from a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 256
MAX_CACHED = 1 << 17
MAX_BATCH_BYTES = 1 << 20
NO_RANK = 1 << 62
# White space as the patterns mean it: engines differ on \s (fixed values).
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for byte in range(256):
        if byte in printable:
            out.append(chr(byte))
        else:
            out.append(chr(free))
            free += 1
    return out


@dataclass
class Vocabulary:
    """Tokens by id, merges by a pair of ids, and the rules for cutting a text into words."""

    tokens: list[str]
    merges: dict[int, int]
    ids: dict[str, int]
    suffix: str
    pattern: str
    special: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file of the kind: NFC, blanks collapsed, lower case, pattern, bytes, BPE with word ends."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or spec["decoder"]:
        raise ValueError("this kind of tokenizer file is not supported")
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for token, number in [*ids.items(), *special.items()]:
        tokens[number] = token
    merges = {}
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        merges.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
    pattern = split["pattern"]["Regex"].replace(r"\s", WHITE_SPACE)
    return Vocabulary(tokens, merges, ids, spec["model"]["end_of_word_suffix"] or "", pattern, special)


def merge_short(parts: list[int], merges: dict[int, int]) -> list[int]:
    """Merge by repeated scans of the rank array (parts and ranks change in place)."""
    look_up = merges.get
    ranks = [look_up(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best == NO_RANK:
            break
        at = ranks.index(best)
        parts[at] = best & 0xFFFFF
        del parts[at + 1], ranks[at]
        if at < len(ranks):
            ranks[at] = look_up(parts[at] << 20 | parts[at + 1], NO_RANK)
        if at:
            ranks[at - 1] = look_up(parts[at - 1] << 20 | parts[at], NO_RANK)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """The same merges in the same order with a heap: O(n log n)."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := merges.get(parts[i] << 20 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= n or merges.get(parts[i] << 20 | parts[j]) != rank:
            continue
        parts[i], parts[j] = rank & 0xFFFFF, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (new := merges.get(parts[i] << 20 | parts[after[i]])) is not None:
                heapq.heappush(heap, (new, i))
        if before[i] >= 0 and (new := merges.get(parts[before[i]] << 20 | parts[i])) is not None:
            heapq.heappush(heap, (new, before[i]))
    return [p for p in parts if p >= 0]


class Words(dict):
    """Word -> its ids as bytes (unsigned, 32 bits, little-endian), filled on demand, of bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.merges = vocabulary.merges
        self.inner = [vocabulary.ids.get(c, -1) for c in byte_characters()]
        self.last = [vocabulary.ids.get(c + vocabulary.suffix, -1) for c in byte_characters()]

    def __missing__(self, word: str) -> bytes:
        *head, end = word.encode("utf-8", "replace")
        parts = [*map(self.inner.__getitem__, head), self.last[end]]
        if -1 in parts:  # bytes that the vocabulary lacks
            parts = [p for p in parts if p >= 0]
        merged = (merge_short if len(parts) <= LONG_WORD else merge_long)(parts, self.merges)
        if len(self) >= MAX_CACHED:
            self.clear()
        out = array("I", merged).tobytes()
        if len(word) <= LONG_WORD:
            self[word] = out
        return out


class Codec:
    """Encodes and decodes single texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.words, self.tokens = Words(vocabulary), vocabulary.tokens
        self.find = regex.compile(vocabulary.pattern).findall
        self.special = {s: array("I", [i]).tobytes() for s, i in vocabulary.special.items()}
        longest = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(longest) + ")").split if longest else None

    def encode(self, text: str) -> bytes:
        """Ids as bytes. Special tokens written in the text become their ids."""
        if self.cut and any(s in text for s in self.special):
            return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.cut(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # Lower case letter by letter: without the rule for a sigma at the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.find(text.lower())))

    def decode(self, ids: bytes) -> str:
        """Tokens as they are, joined by blanks: the vocabulary has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


def encode_documents(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``ids`` (32-bit little-endian unsigned numbers), ``decoded``.

    ``decoded`` is made from the ids. Null and empty texts have no ids and decode to an empty text.
    Repeated rows are encoded each, texts whole, however long; a long word takes a heap of its own. An empty
    table gives no rows. Other columns are not read.
    """
    # Plain values, as tasks need not have this package.
    held = docs.sparkSession.sparkContext.broadcast(vars(read_vocabulary(vocabulary_path)))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A Python worker keeps broadcast values between tasks, and with them the words met before.
        if "codec" not in held.value:
            held.value["codec"] = Codec(Vocabulary(**held.value))
        codec = held.value["codec"]
        for batch in batches:
            start, ids, decoded, size = 0, [], [], 0
            for i, value in enumerate(batch.column(1)):
                ids.append(codec.encode(value.as_py() or ""))
                decoded.append(codec.decode(ids[-1]))
                size += len(ids[-1]) + len(decoded[-1])
                if size >= MAX_BATCH_BYTES or i == batch.num_rows - 1:
                    keys = batch.column(0).slice(start, len(ids))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
                    start, ids, decoded, size = i + 1, [], [], 0

    return rows.mapInArrow(encode, f"doc_id {key_type}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of encoded documents."""
    return encoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
