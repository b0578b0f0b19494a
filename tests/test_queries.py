"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from shelfspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == sorted(df.columns)
    assert got == rows(sql.columns, sql.fetchall())


def test_reachable_feeds_walks_all_hosts(spark):
    reached = {r.node for r in QUERIES["reachable_feeds"](spark, SF).collect()}
    assert reached == {r.folder for r in QUERIES["folder_structure_of_pages"](spark, SF).select("folder").collect()}


def test_member_text_of_an_empty_text(spark, duck, tmp_path):
    docs = spark.createDataFrame([(1, "", "en", "a"), (2, "x", "en", "b")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["archive_member_text"](spark, str(tmp_path))
    connection = duck.cursor()
    connection.sql(f"create temp view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = connection.sql(ORACLES["archive_member_text"])
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())
