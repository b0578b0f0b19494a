"""FM-index and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from shelfspark.llm import decontamination, fm_index

DOCS = "doc_id long, text string, item string, words string, spans string, items string, n_words string, row string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "i", "w", "s", "x", "n", "r") for r in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def by_hand(docs, items, window):
    wins = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1)) if words else []:
            wins.setdefault(tuple(words[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in wins}:
            for i in range(len(words) - size + 1):
                ids = wins.get(tuple(words[i : i + size]))
                if ids is not None:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in ids if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def test_index_finds_all_places():
    rnd = np.random.default_rng(3)
    for n, kinds, rate in [(0, 3, 0), (1, 2, 0), (400, 3, 0.05), (3000, 40, 0.02), (2000, 2, 0.01)]:
        symbols = np.where(rnd.random(n) < rate, 0, rnd.integers(1, kinds, n)).astype(np.int64)
        if n > 1000:
            symbols[500:800] = symbols[100:400]
        symbols = np.append(symbols, 0)
        index = fm_index.FMIndex(symbols, kinds)
        lengths = rnd.integers(1, 6, 60)
        phrases = np.zeros((60, 6), np.int64)
        for row, size in zip(phrases, lengths):
            at = int(rnd.integers(0, max(1, n - size)))
            part = symbols[at : at + size] if rnd.random() < 0.7 else rnd.integers(1, kinds, size)
            part = np.where(part == 0, 1, part)
            row[6 - len(part) :] = part
        lengths = (phrases > 0).sum(axis=1)
        phrases, lengths = phrases[lengths > 0], lengths[lengths > 0]
        low, high = index.ranges(phrases, lengths)
        for i, (row, size) in enumerate(zip(phrases, lengths)):
            wanted = [j for j in range(len(symbols) - size + 1) if (symbols[j : j + size] == row[6 - size :]).all()]
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist() if low[i] < high[i] else []) == wanted


def cases():
    rnd = random.Random(7)
    vocabulary = [f"Wörd{i}" for i in range(30)] + ["a", "b", "7"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(12, items[4][1]), (12, items[4][1]), (13, ""), (14, None), (15, "..."), (None, "only this window has no id at all and so on"), (16, "one")]
    docs = [(1, None), (2, ""), (3, "!?"), (None, items[0][1]), (4, "x " * 40_000 + items[9][1] + " y" * 40_000), (5, "one"), (5, "one"), (5, "two ONE, one")]
    docs += [(6, "Only THIS window-has no id; at all and so on.")]
    for i in range(120):
        parts = [text(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):
            parts.append(rnd.choice(items)[1] or "")
            parts.append(text(rnd.randrange(0, 5)))
        docs.append((100 + i % 70, rnd.choice([" ", ", ", "\n"]).join(parts).upper() if i % 9 == 0 else " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("window, block", [(10, 200_000), (10, 40), (3, 60)])
def test_leaks_agree_with_brute_force(spark, window, block):
    docs, items = cases()
    table = spark.createDataFrame([(*i, "t", 1) for i in items], "item_id long, text string, words string, doc_id int")
    got = decontamination.digests(decontamination.find_leaks(documents(spark, docs), table, window=window, block=block))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(docs, items, window)


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(documents(spark, []), none).collect() == []
    found = decontamination.digests(decontamination.find_leaks(documents(spark, docs), none)).collect()
    assert len(found) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in found)


def test_cleaned_texts_hold_no_window(spark):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.clean_texts(documents(spark, docs), table).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if not r.spans:
            assert (r.doc_id, r.text) in docs
        assert len(words_of(r.text)) == r.n_words - sum(s.length for s in r.spans)
    assert decontamination.without("Aé, b! c-d (e)", [{"start": 1, "length": 2}]) == "Aé,  -d (e)"
