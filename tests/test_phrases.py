"""Phrase search against reading the units one by one."""

import random
import unicodedata

import regex
from pyspark.sql import functions as F

from shelfspark.constants import SPACE_CLASS
from shelfspark.operators.phrases import SENSITIVITY, WORD, search_nodes, search_phrase

SPACE = rf"[{SPACE_CLASS}]"


def folded(text, sensitivity):
    """Letters without case or accents, where the letters of the test are only Latin and Cyrillic ones."""
    text = unicodedata.normalize("NFD", text)
    if sensitivity in ("base", "case"):
        text = regex.sub(r"\p{M}", "", text)
    return text if sensitivity in ("case", "variant") else text.lower()


def by_hand(nodes, query, sensitivity, whole_words):
    """(start node, offset, end node, offset) of each run of units that equals the query."""
    pattern = regex.compile(rf"{SPACE}|{WORD}|(?s:.)" if whole_words else rf"{SPACE}|\X")

    def units(texts):
        out = []
        for node, text in enumerate(texts):
            for found in pattern.finditer(text):
                unit = found.group()
                if regex.fullmatch(r"\p{Cf}+", unit):
                    continue
                if regex.match(SPACE, unit):
                    if not out or out[-1][0] != " ":
                        out.append((" ", node, found.start(), found.start() + 1))
                else:
                    out.append((folded(unit, sensitivity), node, found.start(), found.end()))
        return out

    wanted, all_ = [u[0] for u in units([query])], units(nodes)
    runs = [all_[i : i + len(wanted)] for i in range(len(all_) - len(wanted) + 1)]
    return {(r[0][1], r[0][2], r[-1][1], r[-1][3]) for r in runs if "".join(u[0] for u in r) == "".join(wanted)}


def test_phrase_search(spark):
    df = spark.createDataFrame([(1, "Le  CAFÉ\u00ad\n noir, cafe noirs"), (2, None), (3, "")], "id int, text string")
    spans = lambda *a, **k: [(r.start, r.end) for r in search_phrase(df, "text", *a, **k).orderBy("start").collect()]
    assert spans("cafe noir") == [(4, 15), (17, 26)]
    assert spans("cafe noir", whole_words=True) == [(4, 15)]
    assert spans("café noir", "accent") == [(4, 15)]
    assert spans("cafe noir", "variant") == [(17, 26)]
    assert spans("cafe noir", "case") == [(17, 26)]
    assert spans("") == spans("\u00ad") == []


def test_letters_that_count_as_others(spark):
    df = spark.createDataFrame([(1, "straße ﬁx Łódź ｆｕｌｌ 🇫🇷🇩🇪 Ёлка"), (2, "e\u0301a")], "id int, text string")
    spans = lambda q, **k: [(r.id, r.start, r.end) for r in search_phrase(df, "text", q, **k).collect()]
    assert spans("full") == [(1, 15, 19)]
    assert spans("елка") == [(1, 25, 29)]
    assert spans("🇩🇪") == [(1, 22, 24)]
    # An accent of its own is no unit, and a letter comes with its accents.
    assert spans("ea") == [(2, 0, 3)] and spans("e") == [(1, 5, 6), (2, 0, 2)]


def test_nodes_against_reading_units_one_by_one(spark):
    rng = random.Random(3)
    letters = [*"aAsSe .'1", "é", "e\u0301", "\u00ad", "\u00a0", "\n", "😀", "д", "Д"]
    node = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))
    docs = {i: [node() for _ in range(rng.randint(0, 6))] for i in range(150)}
    df = spark.createDataFrame(list(docs.items()), "id int, s array<string>").cache()
    for query in ("sé", "a s", "ДД", "as.a", " s", "a's"):
        for case, marks, words in ((0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)):
            sensitivity = ("base", "accent", "case", "variant")[2 * case + marks]
            found = search_nodes(df, "s", query, bool(case), bool(marks), bool(words)).collect()
            got = [(r.id, r.start_node, r.start_offset, r.end_node, r.end_offset) for r in found]
            assert sorted(got) == sorted((i, *h) for i, nodes in docs.items() for h in by_hand(nodes, query, sensitivity, words)), (query, case, marks, words)
    assert set(SENSITIVITY) == {"base", "accent", "case", "variant"}


def test_excerpts_and_modes_over_nodes(spark):
    df = spark.createDataFrame([(1, ["say ", "CA", "", None, "FÉ  ", " noir!"], "x"), (2, None, "y"), (3, [], "z")], "id int, s array<string>, start_node string")
    row = search_nodes(df.drop("start_node"), "s", "cafe noir").collect()
    assert [(r.start_node, r.start_offset, r.end_node, r.end_offset, r.pre, r.match, r.post) for r in row] == [(1, 0, 5, 5, "", "CAFÉ   noir", "!")]
    assert search_nodes(df, "s", "cafe", match_case=True).count() == 0
    assert search_nodes(df.drop("start_node"), "s", "café", match_diacritics=True).first().match == "CAFÉ"
    assert search_nodes(df, "s", "noir", whole_words=True).select("id").first().id == 1


def test_hits_do_not_depend_on_the_length_of_the_text(spark):
    text = "é" * 3000 + " café noir " + "x é " * 3000
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r.start, r.end) for r in search_phrase(df, "text", "cafe noir").collect()] == [(3001, 3010)]
    words = search_phrase(df, "text", "X", whole_words=True)
    assert words.agg(F.count(F.lit(1))).first()[0] == 3000
