"""License scan, mixing, sharding, tokens and quality on small hand-made tables."""

import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import bpe, licenses, mixing, rules, sharding

SF = "/root/testdata/sf0.001"
# Extra columns have the names that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, row string, score double, node string"


def documents(spark, rows):
    full = [(i, text, lang, source, 1, "w", "r", 0.5, "n") for i, text, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


EDGE = [
    (1, None, "en", "src0"), (2, "", None, None), (3, " \n\t", "en", "src1"), (None, "The MIT License", "xx", ""),
    (5, "x " * 30000, "de", "src2"), (6, "same", "en", "src0"), (6, "same", "en", "src0"), (6, "other", "en", "src0"), (7, "same", "fr", "src0"),
]


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    found = [(i, label) for label, phrase in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    texts = [
        "Released under the MIT License.", "the mit license; THE-MIT/LICENSE the mit", "Apache License, Version 2.0 and CC BY-NC 4.0, cc.by.nc",
        "thé mit license the mıt license THE MIT LICENSE", "mit license the", "This work is licensed under the GNU General Public License, version 3.",
        "x " * 500 + licenses.NOTICES[3][1] + " y" * 500, licenses.NOTICES[3][1].replace("published by", "published anew by"), "...", "the mit license",
    ]
    rows = EDGE + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    wanted = sorted(((i, *base_of(t)) for i, t, _, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == wanted
    by = {r.doc_id: r for r in got}
    assert by[105].labels == "gpl-3" and by[106].labels == "gpl-3" and by[106].score == 1.0
    assert by[107].labels == "gpl-3" and 0.95 <= by[107].score < 1
    assert by[1].score == 0 and by[1].labels == "" and by[None].labels == "mit"
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def test_license_phrases_of_the_contract(spark):
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    texts = [
        "Released UNDER the MIT License.", "the MIT license", "under the mit licenses under the mit license", "under. the\nmit-license under the mit license",
        "Under under the mit license", "under the mit", "under\x00the\x7fmit{license", "\u212aunder the mit l\u0130cense", "under the mit license\u0301",
        "x\U0001d7d8y under the mit license cc by nc by nc apache license version 2.0", "\x85under the mit\xa0license", "",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        found = sorted((at, label) for phrase, label in phrases for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split())
        wanted = (len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == wanted, text
    # The shorter name is a label of the method, not a base phrase.
    assert got[1].labels == "mit" and got[1].n_base == 0


def spread_by_hand(budget, caps, weights):
    """Fill children whose share is too large for them until none is left."""
    open_children, out = set(caps), {}
    while open_children:
        total = sum(weights[c] for c in open_children)
        full = {c for c in open_children if caps[c] * total <= weights[c] * budget}
        if not full:
            return out | {c: weights[c] * budget // total for c in open_children}
        c = min(full, key=lambda x: (caps[x] / weights[x], x))
        out[c], budget = caps[c], budget - caps[c]
        open_children.remove(c)
    return out


@pytest.mark.parametrize("percent,epochs", [(50, 4), (150, 2), (1000, 3), (0, 1)])
def test_mixing(spark, percent, epochs):
    random.seed(3)
    rows = [
        (i, "w " * random.randint(0, 40), random.choice(["en", "de", "xx"]), random.choice(["src0", "src0", "src1", "src2", "src5", "other"]))
        for i in range(400)
    ]
    taken = mixing.choose(documents(spark, rows), percent, epochs).collect()
    leaf_of = lambda s: (f"d{int(re.sub('[^0-9]', '', s) or 0) % mixing.DOMAINS}", s)
    leaves = {}
    for _, text, lang, source in rows:
        leaves.setdefault((leaf_of(source)[0], lang, source), 0)
        leaves[leaf_of(source)[0], lang, source] += text.count("w")
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, mixing.OTHER)
    total = sum(leaves.values())
    nodes = {(): min(total * percent // 100, total * epochs)}
    for depth, level in enumerate(mixing.LEVELS):
        fresh = {}
        for parent, budget in nodes.items():
            caps = {}
            for leaf, tokens in leaves.items():
                if leaf[:depth] == parent:
                    caps[leaf[: depth + 1]] = caps.get(leaf[: depth + 1], 0) + tokens * epochs
            fresh |= spread_by_hand(budget, caps, {c: weight(level, c[-1]) for c in caps})
        nodes = fresh
    used, longest = {}, {}
    for r in taken:
        leaf = (r.domain, r.lang, r.source)
        used[leaf] = used.get(leaf, 0) + r.n_tokens * r.copies
        assert 1 <= r.copies <= epochs
    for _, text, lang, source in rows:
        leaf = (leaf_of(source)[0], lang, source)
        longest[leaf] = max(longest.get(leaf, 0), text.count("w"))
    for leaf, budget in nodes.items():
        assert budget - longest[leaf] < used.get(leaf, 0) <= budget or budget == used.get(leaf, 0)


def test_mixing_edges(spark):
    docs = documents(spark, EDGE)
    out = mixing.mix(docs, percent=400, max_epochs=4)
    assert out.columns == docs.columns
    rows = out.collect()
    # All tokens are asked for four times, so every row with tokens is there four times.
    assert sum(r.doc_id == 5 for r in rows) == 4 and sum(r.doc_id == 6 and r.text == "same" for r in rows) == 8
    assert mixing.choose(documents(spark, [])).collect() == []
    units = [r for r in mixing.choose(docs, 400, 4).collect() if r.doc_id == 6]
    assert sorted((r.n_rows, r.copies) for r in units) == [(1, 4), (2, 4)]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    values = np.arange(n)
    placed = sharding.permute(values, n, 7)
    assert sorted(placed) == list(range(n))
    assert (sharding.unpermute(placed, n, 7) == values).all()
    if n > 100:
        assert (placed != values).mean() > 0.9 and (placed != sharding.permute(values, n, 8)).any()


def test_shards(spark):
    docs = documents(spark, EDGE + [(100 + i, f"text {i}", "en", "s") for i in range(50)])
    rows = sharding.shard_documents(docs, 16).collect()
    again = sharding.shard_documents(docs.repartition(7), 16).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(slots[s] == list(range(len(slots[s]))) for s in slots)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    by = {r.doc_id: r for r in rows}
    assert by[1].size == 1 and by[1].text_crc32 == 0 and by[5].size == 60001 and by[5].text_crc32 == zlib.crc32(b"x " * 30000)
    assert sharding.shard_documents(documents(spark, []), 16).collect() == []


VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    random.seed(5)
    letters = "abcdefgh  'sS\n\t.,!?0123éÉßñΣσς́ İК漢字　​\U0001f600²½"
    texts = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "it's WE'LL", "ab" * 3000, "", "\x1c\x85\xa0 x"]
    rows = EDGE + [(1000 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = bpe.encode_documents(documents(spark, rows), VOCABULARY).collect()
    found = sorted((str(r.doc_id), list(np.frombuffer(r.ids, "<u4")), r.decoded) for r in got)
    wanted = []
    for i, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert found == sorted(wanted)
    assert bpe.digests(bpe.encode_documents(documents(spark, []), VOCABULARY)).collect() == []


def test_merges_agree():
    vocabulary = bpe.read_vocabulary(VOCABULARY)
    random.seed(9)
    for _ in range(300):
        word = [vocabulary.ids[c] for c in random.choices("abcdeinorst", k=random.randint(1, 90))]
        assert bpe.merge_short(list(word), vocabulary.merges) == bpe.merge_long(list(word), vocabulary.merges)
    with open(VOCABULARY, encoding="utf-8") as file:
        assert len(vocabulary.merges) == len(json.load(file)["model"]["merges"])


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = rules.fit(docs, labels)
    assert model.weights and all(r for r, _ in model.weights)
    scored = rules.score_documents(docs, model)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert scored.count() == docs.count()
    for r in scored.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
    edge = documents(spark, EDGE)
    out = rules.score_documents(edge, model).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    kept = rules.keep_good(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted for r in out)


def test_quality_without_labels(spark):
    docs = documents(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in rules.score_documents(docs, rules.fit(docs, none)).collect()} == {rules.NO_LABELS}
    one = spark.createDataFrame([(i, 1) for i in range(8)] + [(1, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in rules.score_documents(docs, rules.fit(docs, one)).collect()} == {1.0}
    assert rules.score_documents(documents(spark, []), rules.fit(documents(spark, []), none)).collect() == []


def test_rule_paths():
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   If (feature 0 <= 3.0)\n    Predict: 0.0\n   Else (feature 0 > 3.0)\n    Predict: 1.0\n"
    assert rules.tree_rules(text, ["a", "b"]) == {
        frozenset({("a", "<=", 1.5)}), frozenset({("a", "<=", 1.5), ("b", "<=", 2.0)}), frozenset({("a", "<=", 1.5), ("b", ">", 2.0)}),
        frozenset({("a", ">", 1.5)}), frozenset({("a", ">", 1.5), ("a", "<=", 3.0)}), frozenset({("a", ">", 3.0)}),
    }


def test_condition_of_text_statistics(spark):
    stats = rules.statistics(F.col("text"))
    row = documents(spark, [(1, "Ab, c.\nAb 1*", "en", "s")]).select(*[c.cast("double").alias(n) for n, c in stats.items()]).first()
    assert row.upper_share == pytest.approx(2 / 12) and row.mark_share == pytest.approx(1 / 12) and row.digit_share == pytest.approx(1 / 12)
    assert row.distinct_words == pytest.approx(1.0) and row.line_length == 6


def test_quality_filter_computes_each_statistic_once(spark):
    rule = lambda *parts: frozenset(parts)
    limits = [("upper_share", "<=", 0.2), ("mark_share", ">", 0.01), ("digit_share", "<=", 0.3), ("log_chars", ">", 2.0)]
    model = rules.RuleModel(0.5, [(rule(a, b), 0.3 * i) for i, (a, b) in enumerate(zip(limits, limits[1:] + limits[:1]))] * 3)
    docs = documents(spark, EDGE)
    kept = rules.keep_good(docs, model)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 5
    good = {repr(r.doc_id) for r in rules.score_documents(docs, model).collect() if r.predicted}
    assert {repr(r.doc_id) for r in kept.collect()} == good and kept.columns == docs.columns
    assert rules.keep_good(documents(spark, []), model).collect() == []


def test_bpe_memory_of_words_and_batches_is_bounded():
    codec = bpe.Codec(bpe.read_vocabulary(VOCABULARY))
    words = [f"w{i:x}" for i in range(150_000)]
    whole = codec.encode(" ".join(words))
    assert len(codec.words) <= 1 << 17 and bpe.MAX_BATCH_BYTES <= 1 << 20
    assert b"".join(map(codec.encode, words[:2000])) == whole[: len(b"".join(map(codec.encode, words[:2000])))]
