"""Jacobi-Davidson and whitening against dense eigenvectors."""

import math

import numpy as np
import pytest

from shelfspark.llm import whitening
from shelfspark.llm.jacobi_davidson import leading

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dimension, wanted, spectrum", [
    (64, 16, "flat"), (64, 16, "falling"), (200, 16, "flat"), (200, 16, "tied"), (5, 16, "flat"), (1, 3, "flat"), (64, 16, "few"), (20, 4, "zero"),
])
def test_leading_pairs(dimension, wanted, spectrum):
    rng = np.random.default_rng(dimension)
    values = {
        "flat": rng.random(dimension) + 0.5, "falling": 0.8 ** np.arange(dimension), "tied": np.where(np.arange(dimension) < 20, 2.0, 1.0),
        "few": np.where(np.arange(dimension) < 5, 1.0 + np.arange(dimension), 0), "zero": np.zeros(dimension),
    }[spectrum]
    basis = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = leading(lambda block: matrix @ block, dimension, wanted)
    k = min(wanted, dimension)
    assert found == pytest.approx(np.sort(values)[::-1][:k], abs=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * found).max() < 5e-14


def by_hand(rows):
    rows = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for size in {len(v) for _, v in rows}:
        own = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows if len(v) == size]
        fit = sorted({tuple(x) for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
        values, vectors = np.linalg.eigh(z.T @ z / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        keep = int((values > 1e-11 * values[0]).sum()) if values[0] > 0 else 0
        for i, x in own:
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            centred = np.array([float(n * a - s) / n for a, s in zip(x, sums)])
            for c in range(min(16, keep)):
                out.setdefault((repr(i), size, c + 1), []).append((n, deviation, centred @ vectors[:, c] / math.sqrt(values[c]), values[c] / values.sum()))
    return out


def check(got, wanted, sizes):
    found = {}
    for r in got:
        assert r.identity_error <= 1e-4
        found.setdefault((repr(r.vec_id), sizes[repr(r.vec_id)], r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
    assert found.keys() == wanted.keys()
    signs = {}
    for key, rows in found.items():
        for mine, hand in zip(sorted(rows, key=lambda r: abs(r[2])), sorted(wanted[key], key=lambda r: abs(r[2])), strict=True):
            assert mine[:2] == hand[:2] and mine[3] == pytest.approx(hand[3], rel=1e-9)
            assert abs(mine[2]) == pytest.approx(abs(hand[2]), rel=1e-7, abs=1e-7)
            if abs(hand[2]) > 1e-3:
                # One sign for all rows of a component.
                assert signs.setdefault(key[1:], mine[2] * hand[2] > 0) == (mine[2] * hand[2] > 0)


def test_whitening_agrees_with_dense_eigenvectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(20) * 1.3 ** np.arange(20)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(7, rows[8][1]), (None, rows[9][1])]
    bad = [(300, None), (301, []), (302, [1.0] * 19 + [None]), (303, [float("nan")] * 20), (304, [float("inf")] * 20)]
    short = [(400 + i, [float(i % 3), 2.0 * (i % 3), 5.0]) for i in range(9)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad + short], "vec_id long, embedding array<double>, n int, x string")
    sizes = {repr(i): len(v) for i, v in rows + short}
    got = whitening.whiten(df).collect()
    check(got, by_hand(rows + short), sizes)
    # Three points on a line: one component.
    assert {r.component for r in got if r.vec_id in range(400, 409)} == {1}


def test_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(whitening.whiten(table).collect(), by_hand(rows), {repr(i): len(v or []) for i, v in rows})


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    huge = spark.createDataFrame([(i, [1e30 * i, -1e300, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(huge).collect()} == {1}


def test_exact_deviations():
    fit = whitening.Fit(3, [10, -7], np.zeros(0), np.zeros((2, 0)), 0.0, 0.0)
    assert fit.deviations(np.array([[4, 1], [0, 0]])) == [(12 - 10) ** 2 + (3 + 7) ** 2, 149]
    assert fit.deviations(np.array([[2**29, 1], [2**31, 2**31]])) == [(3 * 2**29 - 10) ** 2 + 100, None]


def test_tasks_follow_the_vectors_not_the_shuffle_partitions(spark, monkeypatch):
    assert [whitening.tasks_for(n, 64, 6) for n in (1, 4096, 8193, 51_282, 5_000_000)] == [1, 1, 3, 6, 153]
    packed, inner = [], whitening.checkpointed
    monkeypatch.setattr(whitening, "checkpointed", lambda df: packed.append(inner(df)) or packed[-1])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    check(got, by_hand(rows), {repr(i): 6 for i, _ in rows})
    assert [p.rdd.getNumPartitions() for p in packed] == [1]
