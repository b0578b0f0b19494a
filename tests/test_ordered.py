"""Ordered-group operators against brute force, with groups that lie in several blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators.events import SLICE_INTERVALS, _accepted, _compose, _entries, _transfer, suppress
from shelfspark.operators.ordered import as_of, carry_forward, number_rows, ordered, running_sum


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    # One group holds more than half of the rows.
    data = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(5)}", i, rnd.randrange(10)) for i in range(3000)]
    rnd.shuffle(data)
    return data


def expected(rows):
    groups = {}
    for g, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        n, total, last = groups.get(g, (0, 0, None))
        n, total, last = n + 1, total + v, (v if v % 3 == 0 else last)
        groups[g] = (n, total, last)
        yield g, i, n, total, last


def test_numbers_sums_and_carried_values(spark, rows):
    df = spark.createDataFrame(rows, "g string, i int, v int")
    prepared = ordered(df, ["g"], [F.col("i")])
    done = number_rows(prepared, "n")
    done = running_sum(done, F.col("v"), "total")
    done = carry_forward(done, F.when(F.col("v") % 3 == 0, F.col("v")), "last")
    got = sorted(tuple(r) for r in done.plain().select("g", "i", "n", "total", "last").collect())
    assert got == sorted(expected(rows), key=lambda r: (r[0], r[1]))


def test_no_group_is_spread_over_blocks(spark, rows):
    df = spark.createDataFrame(rows, "g string, i int, v int")
    prepared = number_rows(ordered(df, [], [F.col("i")]), "n")
    assert prepared.df.select("__block").distinct().count() > 1
    assert [r.i for r in prepared.plain().orderBy("n").collect()] == list(range(3000))


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_sums_over_nulls_do_not_depend_on_blocks(spark, partitions):
    values = [None, None, None, 1, 1, 1] + [None] * 40 + [2, None]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("h", i, None) for i in range(20)], "g string, i int, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        done = running_sum(ordered(df, ["g"], [F.col("i")]), F.col("v"), "s").plain().orderBy("g", "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.s for r in done] == [None, None, None, 1, 2] + [3] * 41 + [5, 5] + [None] * 20


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", 1)], "g string, i int")
    got = number_rows(ordered(df, ["g"], [F.col("i")]), "n").plain().filter("g is null").orderBy("i")
    assert [r.n for r in got.collect()] == list(range(1, 51))


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 10), ("b", 3)], "k string, at int")
    right = spark.createDataFrame(
        [("a", 2, 0, "x"), ("a", 5, 0, "y"), ("a", 5, 1, "z"), ("b", 4, 0, "w")] + [("a", 20 + i, 0, "n") for i in range(20)],
        "k string, pos int, tie int, v string",
    )
    got = {(r.k, r.at): r.v for r in as_of(left, right, ["k"], "at", "pos", "v", ["tie"]).collect()}
    assert got == {("a", 1): None, ("a", 5): "z", ("a", 10): "z", ("b", 3): None}


def greedy(events, interval, state=None):
    last, taken = dict(state or {}), []
    for key, ms, seq in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in last or ms - last[key] >= interval:
            last[key] = ms
            taken.append(seq)
    return sorted(taken)


@pytest.mark.parametrize("with_state", [False, True])
def test_suppression_agrees_with_reading_events_one_by_one(spark, with_state):
    rnd = random.Random(3)
    events, now = [], 1_000_000
    for seq in range(4000):
        now += rnd.choice([0, 1, 40, 120, 499, 500, 501]) if rnd.random() < 0.9 else rnd.randrange(200_000)
        hot = rnd.random()
        events.append(("hot" if hot < 0.5 else None if hot < 0.6 else f"k{rnd.randrange(300)}", now, seq))
    state = {"hot": events[40][1], "k1": 999_900} if with_state else None
    df = spark.createDataFrame(events, "key string, ms long, seq long")
    known = spark.createDataFrame(list(state.items()), "key string, last_ms long") if state else None
    got = sorted(r.seq for r in suppress(df, state=known).collect())
    assert got == greedy(events, 500, state)


@pytest.mark.parametrize("per_interval", [1, 2, 5, 20, 100])
def test_suppression_of_one_dense_key_over_many_slices(spark, per_interval):
    rnd = random.Random(per_interval)
    events, now = [], 1_700_000_000_000
    for seq in range(6000):
        now += rnd.randrange(1, max(2, 2 * 500 // per_interval))
        events.append(("hot", now, seq))
        if rnd.random() < 0.05:
            events.append((f"k{rnd.randrange(20)}", now + rnd.randrange(1000), 10_000 + seq))
    df = spark.createDataFrame(events, "key string, ms long, seq long")
    assert sorted(r.seq for r in suppress(df).collect()) == greedy(events, 500)


def test_composed_steps_agree_with_the_slices_one_after_the_other():
    rnd = random.Random(5)
    for _ in range(300):
        interval, n = rnd.choice([5, 20]), rnd.randrange(2, 6)
        width = SLICE_INTERVALS * interval
        parts = []
        for i in range(n):
            times = np.array(sorted({i * width + rnd.randrange(width) for _ in range(rnd.choice([1, 3, 30]))}))
            parts.append({"slice": i, "last_ms": int(times[-1]), "steps": _transfer(times, i * width + interval, interval), "times": times})
        whole = np.concatenate([p["times"] for p in parts])
        steps = _compose(parts, interval, interval)
        for allowed in range(-2, interval + 1):
            taken = _accepted(whole, whole, allowed, interval)
            exit_ms = [s["exit_ms"] for s in steps if s["from_ms"] <= allowed][-1]
            assert exit_ms == taken[-1] if len(taken) else allowed > whole[-1]
            states = _entries(parts, allowed, interval)
            got = [x for p, s in zip(parts, states) for x in _accepted(p["times"], p["times"], s["allowed"], interval)]
            assert got == list(taken)


def test_suppression_of_few_rows(spark):
    assert suppress(spark.createDataFrame([], "key string, ms long, seq long")).collect() == []


def test_suppression_cases(spark):
    events = [("k", 1 + t, i) for i, t in enumerate([0, 300, 499, 500, 900, 1000])]
    df = spark.createDataFrame(events, "key string, ms long, seq long")
    assert sorted(r.ms for r in suppress(df).collect()) == [1, 501, 1001]
