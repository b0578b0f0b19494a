"""Reading positions: conversations are books and their turns are sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.locations import cfi_sort_key
from shelfspark.functions.paths import url_to_path
from shelfspark.operators import reader
from shelfspark.operators.ordered import number_rows, ordered
from shelfspark.queries.base import PATH, query, table
from shelfspark.sources.text import INDEX_DIGITS, parse_dictionary

SECTIONS = """(SELECT *, sum(counted) OVER (PARTITION BY book) AS total, count(*) OVER (PARTITION BY book) AS sections,
  sum(counted) OVER (PARTITION BY book ORDER BY section ROWS UNBOUNDED PRECEDING) - counted AS before FROM (
  SELECT conv_id AS book, turn AS section, role, CASE WHEN role = 'system' THEN 0 ELSE length(text) END AS counted FROM conversations))"""


def conversation_sections(spark, sf_dir) -> DataFrame:
    linear = F.when(F.col("role") == "system", "no")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("book"), F.col("turn").alias("section"), F.length("text").alias("size"), linear.alias("linear"), "role"
    )


@query(f"""SELECT book, section, round(before / total, 9) AS fraction_start, round((before + counted) / total, 9) AS fraction_end FROM {SECTIONS}""")
def section_fractions(spark, sf_dir) -> DataFrame:
    rows = reader.section_fractions(conversation_sections(spark, sf_dir))
    return rows.select("book", "section", F.round("fraction_start", 9).alias("fraction_start"), F.round("fraction_end", 9).alias("fraction_end"))


@query(f"""SELECT book, section, round((size + 0.25 * counted) / total, 6) AS total_fraction, floor(size / 1500)::BIGINT AS location,
  floor((size + 0.25 * counted) / 1500)::BIGINT AS next_location, ceil(total / 1500.0)::BIGINT AS locations,
  0.5 * counted / 1600 AS time_in_section, (total - size) / 1600 AS time_total
  FROM (SELECT *, (before + 0.5 * counted)::DOUBLE AS size FROM (SELECT book, section, counted::DOUBLE AS counted, before::DOUBLE AS before, total::DOUBLE AS total FROM {SECTIONS}))""")
def section_progress(spark, sf_dir) -> DataFrame:
    sections = conversation_sections(spark, sf_dir)
    requests = sections.select("book", "section", F.lit(0.5).alias("fraction"), F.lit(0.25).alias("page_fraction"))
    rows = reader.section_progress(sections, requests, 1500.0, 1600.0)
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select("book", "section", six("total_fraction"), "location", "next_location", "locations", "time_in_section", "time_total")


@query(f"""WITH p AS (SELECT book, any_value(sections) AS sections, unnest([0, 0.1, 0.25, 0.5, 0.75, 0.9, 1])::DOUBLE AS place FROM {SECTIONS} GROUP BY book),
  hit AS (SELECT p.book, p.place, any_value(p.sections) AS sections, arg_max(s.section, s.section) AS section,
    arg_max((p.place + 2.220446049250313e-16 - before::DOUBLE / total) / (counted::DOUBLE / total), s.section) AS part
    FROM p LEFT JOIN {SECTIONS} s ON s.book = p.book AND counted > 0 AND before::DOUBLE / total <= p.place + 2.220446049250313e-16 GROUP BY p.book, p.place)
  SELECT book, place, CASE WHEN place <= 0 THEN 0 WHEN place >= 1 THEN sections - 1 ELSE coalesce(section, 0) END::BIGINT AS section,
  round(CASE WHEN place <= 0 THEN 0 WHEN place >= 1 THEN 1 ELSE coalesce(part, 0) END, 6) AS fraction FROM hit""")
def section_at_fraction(spark, sf_dir) -> DataFrame:
    sections = conversation_sections(spark, sf_dir)
    at = F.explode(F.array(*[F.lit(float(x)) for x in (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)]))
    places = sections.select("book").distinct().select("book", at.alias("at"))
    rows = reader.section_at(sections, places)
    return rows.select("book", F.col("at").alias("place"), "section", F.round("fraction", 6).alias("fraction"))


@query("""SELECT conv_id AS book, turn AS section, last_value(CASE WHEN role = 'user' THEN 'Turn ' || turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS label FROM conversations""")
def toc_at_section(spark, sf_dir) -> DataFrame:
    sections = conversation_sections(spark, sf_dir)
    label = F.concat(F.lit("Turn "), F.col("section").cast("string"))
    toc = sections.filter("role = 'user'").select("book", "section", F.col("section").alias("toc_id"), label.alias("label"))
    return reader.toc_at_section(sections, toc)


@query(f"""WITH s AS {SECTIONS} SELECT p.book, p.section, (p.before + 10)::BIGINT AS position, 'Turn ' || max(t.section) AS label
  FROM s p LEFT JOIN (SELECT * FROM s WHERE role = 'user') t ON t.book = p.book AND t.before <= p.before + 10 GROUP BY ALL""")
def toc_at_position(spark, sf_dir) -> DataFrame:
    sized = reader.sized_sections(conversation_sections(spark, sf_dir))
    label = F.concat(F.lit("Turn "), F.col("section").cast("string"))
    toc = sized.filter("role = 'user'").select("book", F.col("size_before").alias("position"), F.col("section").alias("toc_id"), label.alias("label"))
    places = sized.select("book", "section", (F.col("size_before") + 10).alias("position"))
    return reader.toc_at_position(places, toc)


@query(f"""SELECT split_part(path, '/', 1) AS book, path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY string_split(path, '/')) - 1 AS toc_id
  FROM (SELECT DISTINCT {PATH} AS path FROM pages)""")
def toc_numbering(spark, sf_dir) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(url_to_path("url").alias("path")).distinct()
    toc = paths.select(F.substring_index("path", "/", 1).alias("book"), "path", F.split("path", "/").alias("toc_path"))
    return reader.number_toc(toc).drop("toc_path")


WORDS = """(SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_idx FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM benchmark))"""


def dictionary(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).distinct()
    numbered = number_rows(ordered(words, [], [F.col("word")]), "n").plain()
    return numbered.select((F.col("n") - 1).alias("word_idx"), "word")


@query(f"""SELECT query, word, word_idx FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS query FROM documents) JOIN {WORDS} ON lower(query) = lower(word)""")
def dictionary_lookup(spark, sf_dir) -> DataFrame:
    queries = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("query"))
    return reader.lookup_words(queries, dictionary(spark, sf_dir)).select("query", "word", "word_idx")


@query(f"""SELECT reverse(w1.word) AS query, w2.word, w2.word_idx FROM {WORDS} w1 JOIN {WORDS} w2 ON lower(w1.word) = lower(w2.word) GROUP BY ALL""")
def synonym_lookup(spark, sf_dir) -> DataFrame:
    words = dictionary(spark, sf_dir)
    synonyms = words.select(F.reverse("word").alias("synonym"), "word_idx")
    queries = words.select(F.reverse("word").alias("query"))
    return reader.lookup_synonyms(queries, synonyms, words).select("query", "word", "word_idx").distinct()


@query("SELECT doc_id, 'w' || doc_id AS word, n_chars AS \"offset\", doc_id % 4096 AS size FROM documents")
def dictionary_index(spark, sf_dir) -> DataFrame:
    digit = lambda n: F.substring(F.lit(INDEX_DIGITS), (n % 64 + 1).cast("int"), F.lit(1))
    number = lambda n: F.concat(*[digit(F.floor(n / 64**p)) for p in (3, 2, 1, 0)])
    word = F.concat(F.lit("w"), F.col("doc_id").cast("string"))
    lines = table(spark, sf_dir, "documents").select(F.concat_ws("\t", word, number(F.col("n_chars")), number(F.col("doc_id") % 4096)).alias("value"))
    rows = parse_dictionary(lines)
    return rows.select(F.substring("word", 2, 20).cast("long").alias("doc_id"), "word", "offset", "size")


@query("""SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations""")
def sorted_locations(spark, sf_dir) -> DataFrame:
    c, t = F.col("conv_id") * 2 + 2, F.col("turn") * 2 + 2
    point = F.format_string("epubcfi(/6/%d[ch^]%d]!/4/%d/1:%d)", c, c, t, F.length("text"))
    span = F.format_string("epubcfi(/6/%d!/4/%d,/1:0,/3:%d)", c, t, F.length("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, point).otherwise(span).alias("cfi"))
    keyed = rows.withColumn("__k", cfi_sort_key("cfi"))
    return number_rows(ordered(keyed, [], [F.col("__k")]), "pos").plain().select("conv_id", "turn", "pos")


@query("""WITH r AS (SELECT label, arg_min(embedding, vec_id) AS reference FROM embeddings GROUP BY label)
  SELECT vec_id, round(rmse, 5) AS rmse, rmse < 0.15 AS similar FROM (SELECT vec_id, sqrt(list_sum(list_transform(range(1, len(embedding) + 1),
    lambda i: (embedding[i]::DOUBLE - reference[i]::DOUBLE) ** 2)) / len(embedding)) AS rmse FROM embeddings JOIN r USING (label))""")
def vector_rmse(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    reference = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("reference"))
    rows = reader.vector_rmse(vectors.join(reference, "label"), "embedding", "reference")
    return rows.select("vec_id", F.round("rmse", 5).alias("rmse"), "similar")
