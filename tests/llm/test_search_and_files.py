"""Vector searches, archives, suffix tree, near-duplicates and the pipeline against brute force."""

import collections
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import components, hashing_index, mixing, order_minhash, suffix_tree, vafile, warc
from shelfspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, slice string, vector string, score int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, row string, word string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "v", 1) for i, v in rows], VECTORS)


def random_vectors(n, size, seed):
    random_state = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(random_state.normal(size=(n, size)).round(2).astype(np.float32))]


BAD = [(900, None), (1000, [None] * 6), (1100, [float("nan")] * 6), (1200, [float("inf")] * 6), (1300, []), (1400, [1.0]), (None, [1.0] * 6)]


def by_hand(rows, score, largest, k=10):
    out = []
    for q, x in rows:
        if q % 100 == 0:
            found = sorted(((-s if largest else s, i) for i, y in rows if i != q for s in [score(x, y)]))[:k]
            out += [(q, rank, i, -s if largest else s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def inner(x, y):
    return sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("slice_rows", [64, 4096])
def test_top_products(spark, slice_rows):
    good = random_vectors(330, 6, 1) + [(1000 + i, [0.5] * 6) for i in range(120)] + [(2000, [0.0] * 6)]
    table = vectors(spark, good + [b for b in BAD if b[0] not in {g[0] for g in good}])
    got = vafile.top_inner_products(table, F.col("vec_id") % 100 == 0, slice_rows=slice_rows)
    assert sorted(map(tuple, got.collect())) == by_hand(good, inner, True)


def test_top_products_of_huge_components(spark):
    good = [(0, [2e6, -1e6]), (1, [2e6, 1.0]), (2, [-1.0, 5e5]), (3, [2.0, 2.0])]
    got = vafile.top_inner_products(vectors(spark, good), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == by_hand([(i, list(np.float32(v).astype(float))) for i, v in good], inner, True)


def test_each_length_is_searched_among_its_own(spark):
    sixes, fours = random_vectors(301, 6, 21), [(i + 1000, v) for i, v in random_vectors(201, 4, 22)]
    table, asking = vectors(spark, sixes + fours), F.col("vec_id") % 100 == 0
    rows = lambda found: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())
    assert rows(vafile.top_inner_products(table, asking, slice_rows=100)) == by_hand(sixes, inner, True) + by_hand(fours, inner, True)
    far = lambda x, y: float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()))
    wanted = by_hand(sixes, far, False) + by_hand(fours, far, False)
    assert [x[:3] for x in rows(hashing_index.nearest(table, asking))] == [x[:3] for x in wanted]


def test_searches_of_nothing(spark):
    for search in (vafile.top_inner_products, hashing_index.nearest):
        assert search(vectors(spark, []), F.col("vec_id") % 100 == 0).collect() == []
        assert search(vectors(spark, BAD[:4]), F.col("vec_id") % 100 == 0).collect() == []
        assert search(vectors(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 100 == 0).collect() == []


def distance(x, y):
    return float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum()))


def test_nearest_few_rows_is_exact(spark):
    good = random_vectors(220, 6, 2) + [(1000 + i, [0.5] * 6) for i in range(30)]
    got = hashing_index.nearest(vectors(spark, good + [(300, [0.0] * 6), *BAD[1:4]]), F.col("vec_id") % 100 == 0)
    wanted = by_hand([g for g in good], distance, False)
    found = sorted(map(tuple, got.collect()))
    assert [f[:3] for f in found] == [w[:3] for w in wanted]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in wanted])


def test_nearest_recall(spark):
    table = spark.read.parquet(SF.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, xs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = collections.defaultdict(set)
    for r in hashing_index.nearest(table, F.col("vec_id") % 100 == 0, slice_rows=1024, wanted=80).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((xs - xs[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        near = set(ids[np.lexsort((ids, far))[:10]].tolist())
        hits, total = hits + len(near & found[int(ids[q])]), total + 10
    assert hits >= 0.9 * total


def test_pigeonhole_probing_is_complete():
    codes = np.random.default_rng(4).integers(0, 256, (500, 8)).astype(np.uint8)
    tables = hashing_index.SubstringTables(codes)
    far = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
    for wanted in (1, 5, 60, 499):
        rows = tables.within_radius(codes[0], np.array([0]), wanted)
        radius = np.sort(far[1:])[wanted - 1]
        assert set(rows) == set(np.flatnonzero(far <= radius)) - {0}


PAGES = "page_id long, url string, html string, digest string, kind int, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 9, 9) for r in rows], PAGES)


def test_archives(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "http://a b\r\n/é", ""), (None, "http://n", "unique"), (102, "u", "x\r\n\r\ny" * 9000), (103, "u", "twice"), (103, "u", "twice")]
    folder, other = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    files = warc.write_archives(pages(spark, rows), folder, shard_rows=16, roll_bytes=2000)
    again = warc.write_archives(pages(spark, rows).repartition(7), other, shard_rows=16, roll_bytes=2000)
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, again.collect()))
    assert files.count() > 5 and files.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(spark, folder).collect()
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    wanted = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = (page if page is not None else -1) == last[html or ""]
        wanted[page, len(data), warc.base32(__import__("hashlib").sha1(data).digest()), "response" if first else "revisit", None if first else last[html or ""]] += 1
    twice = next(k for k in wanted if k[0] == 103)
    wanted[twice] = 1
    wanted[(*twice[:3], "revisit", 103)] = 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted
    payloads = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert payloads[102] == b"x\r\n\r\ny" * 9000 and payloads[None] == b"unique"
    empty = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    warc.write_archives(pages(spark, []), empty)
    assert warc.read_archives(spark, empty).collect() == []


def test_small_payloads_are_responses(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    warc.write_archives(pages(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]), folder, min_bytes=5)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", 1, "n", "r", "w") for i, t in rows], DOCS)


def test_scores(spark):
    random.seed(2)
    rows = [(i, " ".join(random.choices(["The", "cat", "SAT", "on", f"w{i}", "é"], k=random.randint(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, " \n"), (202, "a " * 4000), (202, "a b"), (None, "zzz")]
    got = suffix_tree.score_texts(documents(spark, rows), word_share=0.05).collect()
    lower = {i: i + 32 for i in range(65, 91)}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\0"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = collections.Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(
        (str(i), h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
        for (i, _), ws, h in zip(rows, words, held, strict=True)
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == wanted
    assert all(r.score < 0 for r in got)
    assert suffix_tree.score_texts(documents(spark, [])).collect() == []


def test_tree_is_a_distribution(spark):
    texts = documents(spark, [(i, "the cat sat on the mat. " * (1 + i % 3) + chr(97 + i)) for i in range(26)]).select("text")
    runs = suffix_tree.count_runs(texts, 3)
    assert runs.agg(F.sum("n")).first()[0] == texts.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    tree = suffix_tree.grow(runs, runs.agg(F.sum("n")).first()[0], 3, 0.001, 0.002, 0.5)
    assert len(tree.contexts[3]) > 3
    symbols = np.arange(suffix_tree.SYMBOLS)
    for context in (b"the", b"at ", b"zzz", b" ma"):
        key = np.int64(0)
        for c in context:
            key = key << suffix_tree.BITS | c
        logs = tree.look_up(key << suffix_tree.BITS | symbols)
        assert (10**logs).sum() == pytest.approx(1.0)
    sure = lambda text: suffix_tree.blocks([text], 3)
    likely = sum(tree.look_up(r).sum() for r, _, _ in sure(b"the cat sat"))
    assert likely > sum(tree.look_up(r).sum() for r, _, _ in sure(b"tac eht tas")) + 5


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = bytes(random.Random(1).choices(range(97, 123), k=1000))
    whole = [r for r, _, _ in suffix_tree.blocks([text, b"", b"x"], 4)]
    monkeypatch.setattr(suffix_tree, "PIECE", 64)
    monkeypatch.setattr(suffix_tree, "BLOCK", 100)
    parts = list(suffix_tree.blocks([text, b"", b"x"], 4))
    assert len(parts) > 5
    assert (np.concatenate(whole) == np.concatenate([r for r, _, _ in parts])).all()
    assert sum(int((o == 0).sum()) for _, _, o in parts) == 16


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(row[j], above[j + 1])
    return row[-1]


def test_alignment():
    random.seed(8)
    seen = collections.Counter()
    for _ in range(600):
        a = [random.randint(0, random.choice([3, 50])) for _ in range(random.randint(1, 40))]
        b = list(a)
        for _ in range(random.randint(0, 6)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randint(0, 2)] = [random.randint(0, 50)] * random.randint(0, 2)
        b = b or [1]
        m = longest_common(a, b)
        wanted = m / (len(a) + len(b) - m) >= 0.8 - 1e-12
        assert order_minhash.aligned(a, b, 0.8) == wanted
        seen[wanted] += 1
    assert min(seen.values()) > 50


def runs(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


def classes_by_hand(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    items = [runs(re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) or [""]) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or order_minhash.aligned(items[i], items[j], 0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return sorted((str(i), str(min((x for x in m if x is not None), default=None)), len(m)) for m in members.values() for i in m)


def near_rows():
    random.seed(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "One  two"), (1005, "one three"), (None, "alone in the dark night now")]
    for group in range(12):
        text = random.choices(words, k=random.choice([12, 60, 150, 400]))
        for copy in range(random.choice([1, 3, 8])):
            edited = list(text)
            for _ in range(random.randint(0, max(1, len(text) // 60))):
                edited[random.randrange(len(edited))] = random.choice(words)
            rows.append((group * 50 + copy, " ".join(edited)))
    short = [" ".join(f"s{i}" for i in range(n)) for n in (6, 8, 9, 13, 14, 16, 17, 19, 20, 21)]
    rows += [(8000 + i, t) for i, t in enumerate(short)] + [(8100 + i, t + " end") for i, t in enumerate(short)]
    return rows + [(0, rows[7][1]), (0, rows[7][1]), (7000, rows[7][1])]


def test_near_duplicates(spark):
    rows = near_rows()
    got = order_minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == classes_by_hand(rows)
    docs = documents(spark, rows)
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {r.class_id for r in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, classes))
    assert order_minhash.near_duplicates(documents(spark, [])).collect() == []
    assert order_minhash.keep_one(documents(spark, [])).collect() == []


def test_components(spark):
    random.seed(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(random.randint(100, 160), random.randint(100, 160)) for _ in range(40)] + [(5, 5)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def table_rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == sorted(df.columns)
    assert table_rows(df.columns, df.collect()) == table_rows(sql.columns, sql.fetchall())


def test_pipeline(spark):
    """Every stage against what its input should become."""
    import corpus_pipeline as pipeline
    duckdb = pytest.importorskip("duckdb")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    kept = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    source = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"] for r in kept["quality"]}
    assert all(source[r["doc_id"]] == r for r in kept["quality"])
    assert sum((i in good) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    classes = classes_by_hand([(r["doc_id"], r["text"]) for r in kept["quality"]])
    assert sorted(str(r["doc_id"]) for r in kept["near_duplicates"]) == sorted({c for _, c, _ in classes})
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{folder}/near_duplicates/*.parquet'")
    drawn = connection.sql(mixing.choose_sql(pipeline.MIX_PERCENT, pipeline.MIX_EPOCHS)).fetchall()
    wanted = collections.Counter({row[0]: row[-1] for row in drawn})
    assert collections.Counter(r["doc_id"] for r in kept["mixture"]) == wanted
    assert sorted((r["doc_id"], r["n_tokens"]) for r in kept["tokens"]) == sorted(
        (r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids)) for r in kept["mixture"]
    )


def test_large_group_of_copies_costs_few_pairs(spark):
    """Copies of one text that are hardly similar to each other, and pairs among them that are."""
    random.seed(12)
    words = [f"w{i}" for i in range(3000)]
    base = random.choices(words, k=200)
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        edited = list(base)
        for _ in range(random.choice([3, 4, 5, 6, 7, 8])):
            edited[random.randrange(200)] = random.choice(words)
        rows.append((i, " ".join(edited)))
        if i % 10 == 0:
            edited[5] = "twin"
            rows.append((1000 + i, " ".join(edited)))
    got = order_minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == classes_by_hand(rows)
    assert len({r.class_id for r in got}) > 10


def test_texts_at_the_edge_of_similarity_share_a_sketch():
    """All sizes at similarity 0.8: the matched shingles in order, all others different."""
    random_state = np.random.default_rng(8)
    items = lambda n: random_state.integers(0, 1 << 63, n, dtype=np.uint64)
    with_others = lambda common, n: np.insert(common, np.sort(random_state.integers(0, len(common) + 1, n - len(common))), items(n - len(common)))
    for n in [*range(4, 65), 80, 120, 200]:
        for m in {n, (n + math.ceil(n / 0.8)) // 2, math.floor(n / 0.8)}:
            k = order_minhash.needed(n, m, 0.8)
            for _ in range(15 if k <= n else 0):
                common = items(k)
                a, b = with_others(common, n), with_others(common, m)
                assert order_minhash.aligned(a.tolist(), b.tolist(), 0.8)
                assert set(order_minhash.sketches_of(a, 0.8)) & set(order_minhash.sketches_of(b, 0.8)), (n, m, k)


def test_texts_are_sketched_together_as_one_by_one(monkeypatch):
    """Many texts of a batch, in few pieces or many, have the sketches and shingles that each has alone."""
    random_state, long_word = np.random.default_rng(3), "x" * 100
    texts = [" ".join(f"w{w}" for w in random_state.integers(0, 50, n)) for n in [0, 1, 3, 4, 5, 6, 9, 15, 20, 21, 40, 300, 2000, 2]]
    texts += [None, f"{long_word} b {long_word} {long_word}c d", "éa " * 30, "one two three four five six seven"]
    alone = [order_minhash.batch_shingles(*order_minhash.batch_words(pa.array([t], pa.string())))[0] for t in texts]
    raw, at = order_minhash.batch_shingles(*order_minhash.batch_words(pa.array(texts, pa.string())))
    assert [raw[i:j].tolist() for i, j in zip(at, at[1:])] == [x.tolist() for x in alone]
    items = [order_minhash.labelled(x) for x in alone]
    wanted = [order_minhash.sketches_of(x, 0.8).tolist() for x in items]
    for table, below in ((1 << 15, 12), (64, 12), (1 << 15, 3)):
        monkeypatch.setattr(order_minhash, "TABLE", table)
        # With too few items below the bound most texts are looked through, with the same result.
        monkeypatch.setattr(order_minhash, "BELOW", below)
        made, ends = order_minhash.batch_sketches(np.concatenate(items), at, 0.8)
        assert [made[i:j].tolist() for i, j in zip(ends, ends[1:])] == wanted


def test_words_are_told_apart_by_all_their_bytes():
    words = sorted({"a" * n + end for n in range(0, 80) for end in ("", "b", "c", "\u00e9")} - {""})
    array = pa.array(["skipped", *words], pa.string())
    assert len(set(order_minhash.word_hashes(array.slice(1)).tolist())) == len(words)
    assert order_minhash.word_hashes(array.slice(1)).tolist() == order_minhash.word_hashes(pa.array(words, pa.large_string())).tolist()


def test_hub_links_what_the_alignment_links():
    random_state = np.random.default_rng(5)
    for n in (1, 5, 20, 60, 200):
        for _ in range(40):
            x = random_state.integers(0, 4 * n, n, dtype=np.uint64)
            y = np.delete(x, random_state.integers(0, n, random_state.integers(0, max(1, n // 6))))
            y = np.insert(y, random_state.integers(0, len(y) + 1, n // 12), random_state.integers(0, 4 * n, n // 12, dtype=np.uint64))
            if random_state.integers(2):
                y = np.roll(y, random_state.integers(0, max(1, n // 3)))
            shared = np.isin(order_minhash.labelled(y), order_minhash.labelled(x))
            enough = int(shared.sum()) >= order_minhash.needed(len(x), len(y), 0.8)
            got = order_minhash.Hub(x).compared(y, 0.8)
            assert got[:2] == (enough, enough and order_minhash.aligned(x.tolist(), y.tolist(), 0.8))
            assert got[2].tolist() == order_minhash.labelled(y)[~shared].tolist()


def test_rows_that_stay_are_told_by_the_fewer_keys(spark, monkeypatch):
    """No shuffle of the texts, whether few rows go or few stay; a repeated row stays once."""
    monkeypatch.setattr(order_minhash, "MAX_BROADCAST_ROWS", 12)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for texts, copies in ((20, 1), (2, 15)):
            rows = [(i, f"text number {i % texts} of its own", 1.0) for i in range(texts * copies + (texts > 2))]
            kept = order_minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, z double"))
            assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, kept.collect())) == rows[:texts]
        doubled = [(None, "one more text of five", 1.0), (None, "one more text of five", 1.0), (3, "one more text of five", 2.0), *rows[:2]]
        kept = order_minhash.keep_one(spark.createDataFrame(doubled, "doc_id long, text string, z double")).collect()
        assert sorted(map(tuple, kept), key=repr) == sorted([doubled[0], *rows[:2]], key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pairs_that_meet_in_many_shingles_are_few_rows(spark):
    """All nodes of hub 1 have 6 shingles; shingle 9 is strong for node 3 only, so a pair that it tells is told there."""
    rows = [(1, s, n, True) for s in range(6) for n in range(10)] + [(2, s, n, n == 3 and s == 9) for s in (4, 9) for n in (1, 2, 3)]
    table = spark.createDataFrame([(h, s, n, 20, n, n, t) for h, s, n, t in rows], "hub long, shingle long, node long, size long, rank long, root long, strong boolean")
    groups = order_minhash.small_groups(table, ["hub", "shingle"], 128)
    got = [(r.a, r.b) for r in order_minhash.close_pairs(groups, 0.8).collect()]
    every = [(x, y) for x in range(10) for y in range(x + 1, 10)]
    assert sorted(got) == sorted([*every, (1, 3), (2, 3)])


def test_pairs_at_the_edge_are_linked(spark):
    """22 words of which the last two differ: 16 of 18 shingles match on both sides, similarity 0.8."""
    rows = []
    for i in range(60):
        words = [f"p{i}w{j}" for j in range(24)]
        rows += [(2 * i, " ".join(words[:22])), (2 * i + 1, " ".join(words[:20] + words[22:]))]
    got = order_minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == [(i, i - i % 2, 2) for i in range(120)]


def test_texts_with_common_passages_cost_few_pairs(spark):
    """Many texts share two passages, one of which the hub lacks; some are copies of each other, some in another order."""
    random.seed(21)
    words = [f"w{i}" for i in range(5000)]
    first, second = random.choices(words, k=30), random.choices(words, k=25)
    rows = [(0, " ".join(first + random.choices(words, k=12)))]
    for i in range(1, 120):
        own = random.choices(words, k=20)
        rows.append((i, " ".join(first + own + second)))
        if i % 15 == 0:
            own[3] = "other"
            rows.append((1000 + i, " ".join(first + own + second)))
        if i % 20 == 0:
            rows.append((2000 + i, " ".join(second + first + own)))
            own[9] = "another"
            rows.append((3000 + i, " ".join(second + first + own)))
    got = order_minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == classes_by_hand(rows)
    assert sum(r.class_size > 1 for r in got) > 20


def test_buckets_are_compared_as_stars(spark):
    rows = [("s", i, 10 + i, i % 3) for i in range(50)] + [("t", i, 5, 1) for i in range(60, 70)]
    rows += [("u", i, i, i) for i in range(70, 75)]
    rows = [(*r, r[0] != "u") for r in rows] + [("v", -(1 << 63), 7, 1, True), ("v", (1 << 63) - 1, 7, 2, True), ("v", 5, 90, 3, True), ("v", -5, 90, 4, True)]
    buckets = spark.createDataFrame(rows, "shingle string, node long, count long, root long, strong boolean")
    ranked = buckets.withColumn("rank", order_minhash.rank_of("count", "node"))
    got = {(r.a, r.b) for r in order_minhash.star(ranked, ["shingle"]).collect()}
    assert got == {(49, i) for i in range(49)} | {(-5, 5), (-5, -(1 << 63)), (-5, (1 << 63) - 1)}


def test_small_buckets_are_settled_in_one_round(spark, monkeypatch):
    """All pairs of small buckets that may be similar are compared at once; larger ones go on as stars."""
    rows = [("s", i, 10 + i, i, i % 2 == 0, 100) for i in range(4)] + [("t", 1, 11, 1, True, 100), ("t", 9, 9, 9, True, 79)]
    rows += [("u", 100 + i, 5 + i, i, True, 10) for i in range(order_minhash.SMALL_BUCKET + 1)]
    buckets = spark.createDataFrame(rows, "value string, node long, count long, root long, strong boolean, size long")
    ranked = buckets.withColumn("rank", order_minhash.rank_of("count", "node"))
    got = {(r.a, r.b, r.hub) for r in order_minhash.meetings(ranked, ["value"], 0.8).collect()}
    last = 100 + order_minhash.SMALL_BUCKET
    assert got == {(j, i, False) for i in range(4) for j in range(i + 1, 4) if not i * j % 2} | {(last, i, True) for i in range(100, last)}
    random.seed(30)
    words, texts = [f"w{i}" for i in range(900)], []
    for family in range(3):
        base = random.choices(words, k=120)
        for i in range(12):
            edited = base[:60] + random.choices(words, k=60) if i % 3 == 0 else list(base)
            edited[random.randrange(60)] = "other"
            texts.append((family * 100 + i, " ".join(edited)))
    rounds, inner = [], order_minhash.compare
    monkeypatch.setattr(order_minhash, "compare", lambda *a: rounds.append(1) or inner(*a))
    found = order_minhash.near_duplicates(documents(spark, texts)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in found) == classes_by_hand(texts)
    assert not rounds


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    random.seed(5)
    links = [(i + 1, i) for i in range(60)] + [(random.randint(-300, -100), random.randint(-300, -100)) for _ in range(150)] + [(7, 7), (1 << 62, -(1 << 62))]
    table = spark.createDataFrame(links, "a long, b long")
    monkeypatch.setattr(components, "small_star", None)
    few = {r.node: r.root for r in components.components(table).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(components, "FEW", -1)
    assert few == {r.node: r.root for r in components.components(table).collect()}
    assert few[60] == 0 and few[1 << 62] == -(1 << 62)


@pytest.mark.parametrize("kind", ["copies", "passage"])
def test_pairs_compared_grow_with_a_group_not_with_its_square(spark, monkeypatch, kind):
    """Near copies of one text, and texts that have a passage in common without being similar."""
    random.seed(31)
    words, n = [f"w{i}" for i in range(2000)], 100
    base, texts = random.choices(words, k=60), []
    for i in range(n):
        text = list(base)
        if kind == "copies":
            text[random.randrange(60)] = f"other{i}"
        else:
            text[35:] = random.choices(words, k=25)
        texts.append((i, " ".join(text)))
    seen, inner = [], order_minhash.similar_pairs
    monkeypatch.setattr(order_minhash, "similar_pairs", lambda pairs, *a: seen.append(pairs.count()) or inner(pairs, *a))
    found = order_minhash.near_duplicates(documents(spark, texts)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in found) == classes_by_hand(texts)
    assert sum(seen) < 8 * n


@pytest.mark.parametrize("most", [25, 7])
def test_shingles_that_one_node_of_a_hub_has_are_no_rows(spark, monkeypatch, most):
    """Shingles 5 and 6 meet, also as strong and weak and over tasks; 7 is given by two hubs, the others by one node."""
    monkeypatch.setattr(order_minhash, "MOST_MARKS", most)
    rows = [(1, 10, [5, 100], [6]), (1, 11, [5, 6], [101]), (2, 12, [7], []), (3, 13, [7], [102]), (2, 14, [], [-1]), (4, 15, [0], []), (4, 16, [0], [])]
    rows += [(9, 1000 + i, list(range(1000 * i, 1000 * i + 20)), []) for i in range(1, 40)]
    rays = spark.createDataFrame(rows, "a long, b long, strong array<long>, weak array<long>").repartition(3)
    got = {r.b: (sorted(r.strong), sorted(r.weak)) for r in order_minhash.met_shingles(rays).collect()}
    wanted = {10: ([5], [6]), 11: ([5, 6], []), 15: ([0], []), 16: ([0], [])}
    assert order_minhash.met_shingles(rays.limit(0)).collect() == []
    if most == 25:
        assert {b: x for b, x in got.items() if b < 1000} == wanted
        assert sum(len(strong) for b, (strong, _) in got.items() if b >= 1000) < 200
    assert all(set(strong) <= set(got[b][0]) and set(weak) <= set(got[b][1]) for b, (strong, weak) in wanted.items())


def test_runs_are_counted_and_searched_in_order():
    random_state = np.random.default_rng(2)
    for runs in (random_state.integers(0, 50, 400), np.array([7]), np.zeros(0, np.int64)):
        kinds, often, order = suffix_tree.distinct(runs)
        wanted, counts = np.unique(runs, return_counts=True)
        assert kinds.tolist() == wanted.tolist() and often.tolist() == counts.tolist()
        assert np.repeat(kinds, often).tolist() == runs[order].tolist()
