"""Values that must give a defined result instead of ending the job."""

from pyspark.sql import functions as F

from shelfspark.formats.mobi import _utf8
from shelfspark.functions import text as t
from shelfspark.functions.locations import cfi_sort_key
from shelfspark.functions.natural import natural_key
from shelfspark.operators.search import words
from shelfspark.sources.text import decode_index_number


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_long_runs_of_references(spark):
    assert one(spark, t.decode_entities(F.repeat(F.lit("&#65;"), F.lit(50_000)))) == "A" * 50_000
    assert one(spark, t.decode_entities(F.repeat(F.lit("&#X41;"), F.lit(50_000)))) == "A" * 50_000


def test_halves_of_pairs(spark):
    text = "a&#55357;b &#55357;&#56832; &#56832;&#55357; &#xD83D; &#55357;&#55357;&#56832;"
    assert one(spark, t.decode_entities(F.lit(text))) == "a�b \U0001f600 �� � �\U0001f600"


def test_long_words(spark):
    docs = spark.createDataFrame([(1, "a." * 20_000), (2, "1." * 3_000), (3, "don't 3.14 x")], "i int, s string")
    found = {r.i: (r.n, r.longest) for r in words(docs, "s").groupBy("i").agg(F.count("*").alias("n"), F.max(F.length("word")).alias("longest")).collect()}
    assert found == {1: (1, 39_999), 2: (1, 5_999), 3: (3, 5)}


def test_numbers_that_do_not_fit(spark):
    key = one(spark, cfi_sort_key(F.lit("epubcfi(/6/99999999999999999999999!/4:3)")))
    assert key.start[0].steps == [6, 2**63 - 1]
    assert one(spark, decode_index_number(F.lit("z" * 30))) is None
    assert one(spark, decode_index_number(F.lit("BA"))) == 64
    assert one(spark, t.year_month(F.lit(1e300), F.lit(2.0))) is None
    assert one(spark, t.year_month(F.lit("2020"), F.lit("x"))) == "2020"


def test_bytes_that_are_not_utf8(spark):
    data = spark.createDataFrame([(bytes([0x63, 0xE9, 0x41, 0, 0x42]),), (None,)], "b binary").select(_utf8(F.col("b")).alias("x")).collect()
    assert sorted(r.x or "" for r in data) == ["", "c�A"]


def test_very_long_numbers_in_natural_order(spark):
    names = spark.createDataFrame([("1" + "0" * 10_000,), ("9" * 9_999,), ("2",)], "n string")
    assert [len(r.n) for r in names.orderBy(natural_key("n")).collect()] == [1, 9_999, 10_001]


def test_text_nodes(spark):
    from shelfspark.functions.markup import block_texts, text_segments

    html = """<body><p title="a>b" class='c"d'>AT&amp;T &#65;</p><p title="x>plain</p><div>&nosuch;</div>""" + "<b x='1'>" * 20_000
    row = spark.createDataFrame([(html,)], "h string").select(
        text_segments("h").alias("s"), block_texts("h").alias("b"), text_segments("h", lambda t: t.contains("&")).alias("k")
    ).first()
    assert row.s[0] == "AT&T A" and "plain" in row.s and row.b[0] == "AT&T A" and row.k == ["AT&T A", "&nosuch;"]


def test_sections_are_nodes_as_they_stand(spark):
    from shelfspark.functions.markup import text_segments

    rows = [
        (1, "<body><p>a &amp; b<![CDATA[1 > 0 &amp; <b>x</b>]]>c</p><i>d</i></body>"), (2, "<![CDATA[]]>x<![CDATA[no end <p>"), (3, None),
        (4, "<p>]]> a < b</p><![CDATA[" + "]" * 50_000 + "]]><![CDATA[z]]>"), (5, ""), (6, "<![CDATA[only]]>"),
    ]
    df = spark.createDataFrame(rows, "id int, h string")
    got = {r.id: r.s for r in df.select("id", text_segments("h").alias("s")).collect()}
    assert got == {
        1: ["a & b", "1 > 0 &amp; <b>x</b>", "c", "d"], 2: ["x", "no end <p>"], 3: None,
        4: ["]]> a ", "]" * 50_000, "z"], 5: [], 6: ["only"],
    }
