"""Registered queries of this subpackage, with the SQL that must agree with them where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, conversations, decontamination, hashing_index, licenses, mixing, order_minhash, rules, sharding, suffix_tree, vafile, warc, whitening
from shelfspark.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(licenses.scan_sql())
def op1_license_scan(spark, sf_dir) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query(mixing.choose_sql())
def op8_mixture(spark, sf_dir) -> DataFrame:
    return mixing.choose(table(spark, sf_dir, "documents"))


@query()
def op10_shards(spark, sf_dir) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query()
def op7_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), path))


@query()
def op9_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.score_documents(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""")
def op4_top_products(spark, sf_dir) -> DataFrame:
    return vafile.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op6_nearest(spark, sf_dir) -> DataFrame:
    return hashing_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS last FROM d GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN m USING (hex)
""")
def op3_warc(spark, sf_dir) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).drop("url", "payload")


@query()
def op2_suffix_tree(spark, sf_dir) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


@query()
def op5_near_duplicates(spark, sf_dir) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(decontamination.leaks_sql())
def op13_decontamination(spark, sf_dir) -> DataFrame:
    leaks = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digests(leaks)


@query()
def op12_whitening(spark, sf_dir) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(conversations.repair_sql())
def op11_conversations(spark, sf_dir) -> DataFrame:
    return conversations.repair_damaged(table(spark, sf_dir, "conversations"))
