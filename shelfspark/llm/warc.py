"""Deterministic sharded writer of web archives (WARC 1.1), and the reader of what it wrote.

1. Keys (page, digest of the payload) are range-sorted and numbered; every ``SHARD_ROWS``-th key is the
   first of a shard. Only these boundary keys, one per shard, come to the driver.
2. The pages are dealt to the shards once and sorted there. Of equal payloads the largest page is the
   response; the others become revisits, told by a small row that sorts just before the page. One task
   streams a shard through a compressor, one member per record, and rolls to a new file when the file
   has ``ROLL_BYTES`` compressed bytes. Headers, lengths and digests are made anew.
3. A file is written under a temporary name and renamed when it is complete; the manifest, a table
   of the complete files, is written last by Spark. Readers open what the manifest lists.

The same pages give the same files, byte by byte, at any number of tasks, so a task that is run again
replaces a file by its equal. Folders are addresses that both Spark and pyarrow can open.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.numbering import numbered

SHARD_ROWS = 4096
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
CHUNK = 1 << 20
BATCH_ROWS = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}:{copy}')}>"


def clean_url(url: str) -> str:
    """Blanks and control characters, which would break a header, percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page, url: str | None, payload: bytes, copy: int, refers: tuple | None) -> bytes:
    """One record; ``refers`` is (page, url) of the response that has the same payload."""
    sha = base32(hashlib.sha1(payload).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is None:
        block += payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, sha, copy)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean_url(url)}")
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers[0], sha, 0)}"]
        if refers[1] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {clean_url(refers[1])}")
        if refers[0] is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers[0]}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ShardWriter:
    """Files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.done, self.stream = shard, roll_bytes, [], None

    def write(self, data: bytes) -> None:
        if self.stream is None:
            self.temporary = f"{self.root}/.writing-{uuid.uuid4().hex}"
            self.stream, self.hash, self.size, self.records = self.fs.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.stream.write(member)
        self.hash.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if self.stream is not None:
            self.stream.close()
            name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.fs.move(self.temporary, f"{self.root}/{name}")
            self.done.append((self.shard, name, self.records, self.size, self.hash.hexdigest()))
            self.stream = None


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, shard_rows: int = SHARD_ROWS, roll_bytes: int = ROLL_BYTES,
    key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder``; returns the manifest.

    A null page is an empty payload, a null url has no target address. Payloads below ``min_bytes`` are
    never revisits. Null pages sort first and are the smallest. Rows with equal page and payload are kept
    together: the first is the response, or all revisit that of a larger page. A payload is one record,
    however long. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys, _ = numbered(rows.select("page_id", "digest", "url", F.length("payload").alias("size")), ["page_id", "digest"], "place")
    firsts = keys.filter(f"place > 0 AND place % {shard_rows} = 0").select("place", "page_id", "digest").orderBy("place").collect()
    low = -(1 << 63)
    bounds = [(low if r["page_id"] is None else r["page_id"], r["digest"]) for r in firsts]

    @F.pandas_udf("int")
    def shard_of(pages: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, pair) for pair in zip(pages, digests, strict=True)], dtype="int32")

    # The response of every payload that occurs more than once.
    chosen = keys.filter(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("n"),
        F.max_by("url", F.struct("page_id", "url")).alias("refers_url"),
    ).filter("n > 1")
    revisits = keys.join(chosen, "digest").filter("NOT page_id <=> refers")
    revisits = revisits.select("page_id", "digest", "refers", "refers_url").distinct()
    told = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.col("refers_url").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers")
    dealt = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers"))
    both = told.unionByName(dealt).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(low)), "digest"))
    both = both.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, told, last, copy = None, None, None, 0
        for batch in batches:
            columns = [batch.column(n) for n in ("shard", "page_id", "digest", "kind", "url", "payload", "refers")]
            for i in range(batch.num_rows):
                shard, page, digest, kind, url, payload, refers = (c[i].as_py() for c in columns)
                if writer is None or writer.shard != shard:
                    if writer:
                        writer.roll()
                        yield manifest(writer.done)
                    writer = ShardWriter(folder, shard, roll_bytes)
                if kind == 0:
                    told = (page, digest, (refers, url))
                    continue
                copy = copy + 1 if last == (page, digest) else 0
                if copy == 0:
                    first_url = url
                last = (page, digest)
                link = told[2] if told and told[:2] == last else None
                if link is None and copy and len(payload) >= min_bytes:
                    link = (page, first_url)
                writer.write(record(page, url, payload, copy, link))
        if writer:
            writer.roll()
            yield manifest(writer.done)

    path = f"{folder}/manifest"
    both.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(files: list[tuple]) -> pa.RecordBatch:
    kinds = [("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def members(stream) -> Iterator[bytes]:
    """Contents of the members of a compressed stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while chunk := stream.read(CHUNK):
        while chunk:
            parts.append(unpacker.decompress(chunk))
            chunk = b""
            if unpacker.eof:
                yield b"".join(parts)
                chunk, parts, unpacker = unpacker.unused_data, [], zlib.decompressobj(31)
    if parts:
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> tuple:
    """(page, payload length, digest, type, page referred to, url, payload); digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    sha, kind, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32(hashlib.sha1(payload).digest()) != sha:
            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    length = number("X-Payload-Length") if payload is None else len(payload)
    return number("X-Page-Id"), length, sha, kind, number("X-Refers-To-Page-Id"), fields.get("WARC-Target-URI"), payload


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files in the manifest. ``payload`` is null for revisits."""
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    # A file is the unit of work; the manifest is tiny, so its rows are dealt out first.
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data))
                        size += len(data)
                        if len(rows) >= BATCH_ROWS or size >= 16 * CHUNK:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    return dealt.mapInArrow(read, RECORDS)
