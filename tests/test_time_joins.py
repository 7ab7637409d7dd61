"""As-of and interval joins against direct forms."""

import random

import pytest
from pyspark.sql import functions as F

from halocline.operators import time_joins
from halocline.operators.time_joins import asof_join, interval_join, nearest_in_time


def sides(seed):
    rng = random.Random(seed)
    keys = ["hot"] * 20 + ["a", "b", "c", None]
    left = [(k, rng.choice(keys), rng.choice([None, *range(60)])) for k in range(300)]
    right = [(rng.choice(keys), rng.choice([None, *range(60)]), f"v{rng.randrange(50):02d}") for _ in range(120)]
    return left, right


@pytest.mark.parametrize("seed,partitions,forward", [(1, 1, False), (2, 7, False), (3, 40, False), (4, 7, True)])
def test_asof_equals_a_search(spark, seed, partitions, forward):
    left, right = sides(seed)
    l, r = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string")
    got = {x.id: (x.right_time, x.v) for x in asof_join(l, r, ["k"], "t", ["v"], forward, partitions=partitions).collect()}
    assert len(got) == 300
    for i, k, t in left:
        own = [(u, v) for kk, u, v in right if None not in (k, t, u) and kk == k and (u >= t if forward else u <= t)]
        want = max(own, key=lambda x: (-x[0] if forward else x[0], x[1])) if own else (None, None)
        assert got[i] == want, (i, k, t)


def test_asof_small_batches_tolerance_and_empty_sides(spark):
    left, right = sides(9)
    l, r = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string")
    whole = sorted(map(str, asof_join(l, r, ["k"], "t", ["v"]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, asof_join(l, r, ["k"], "t", ["v"]).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = asof_join(l, r, ["k"], "t", ["v"], tolerance=F.col("t") - F.col("right_time") <= 1).collect()
    assert all(x.right_time is None or x.t - x.right_time <= 1 for x in near) and any(x.v for x in near)
    assert {x.v for x in asof_join(l, r.limit(0), ["k"], "t", ["v"]).collect()} == {None} and asof_join(l.limit(0), r, ["k"], "t", ["v"]).count() == 0


def test_intervals_of_every_width(spark):
    rng = random.Random(6)
    spans = [(k, rng.choice("ab"), s, s + rng.choice([-1, 0, 1, 2, 3, 7, 8, 50, 1000, 10**6])) for k in range(150) for s in [rng.randrange(-200, 400)]] + [(900, None, 0, 9), (901, "a", None, 9)]
    times = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(-210, 420)])) for k in range(200)] + [(900, "a", 10**6)]
    i, p = spark.createDataFrame(spans, "id int, k string, s long, e long"), spark.createDataFrame(times, "pid int, k string, at long")
    fits = lambda s, e, t: None not in (s, e, t) and s <= t <= e
    got = sorted((r.id, r.pid) for r in interval_join(i, p, "s", "e", "at", ["k"]).collect())
    assert got == sorted((a, b) for a, k, s, e in spans for b, kk, t in times if k is not None and k == kk and fits(s, e, t))
    free = sorted((r.id, r.pid) for r in interval_join(i.drop("k"), p.drop("k"), "s", "e", "at").collect())
    assert free == sorted((a, b) for a, _, s, e in spans for b, _, t in times if fits(s, e, t))
    assert interval_join(i.limit(0), p, "s", "e", "at", ["k"]).count() == 0


def test_nearest_in_time_equals_a_search(spark):
    left, right = sides(12)
    l, r = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string")
    got = {x.id: (x.right_time, x.v) for x in nearest_in_time(l, r, ["k"], "t", ["v"], lambda a, b: b - a, partitions=5).collect()}
    for i, k, t in left:
        own = [(abs(u - t), u, v) for kk, u, v in right if None not in (k, t, u) and kk == k]
        near = min(own)[:2] if own else None
        assert got[i] == ((near[1], max(v for _, u, v in own if u == near[1])) if near else (None, None))


def test_intervals_over_many_parts(spark, monkeypatch):
    """A hot key, in parts of a few instants, batches of a few rows and pairs handed on in pieces."""
    monkeypatch.setattr(time_joins, "PART_ROWS", 20)
    monkeypatch.setattr(time_joins, "PAIRS", 7)
    rng = random.Random(3)
    spans = [(k, rng.choice(["hot"] * 9 + ["b", "c"]), s, s + rng.choice([0, 5, 90, 400])) for k in range(200) for s in [rng.randrange(300)]]
    times = [(k, rng.choice(["hot"] * 9 + ["b", "d"]), rng.choice([100, rng.randrange(300)])) for k in range(500)]
    i, p = spark.createDataFrame(spans, "id int, k string, s int, e int"), spark.createDataFrame(times, "pid int, k string, at int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = sorted((r.id, r.pid) for r in interval_join(i, p, "s", "e", "at", ["k"]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((a, b) for a, k, s, e in spans for b, kk, t in times if k == kk and s <= t <= e)


def test_an_interval_join_sends_an_instant_once(spark):
    """The rows that are exchanged don't grow with the classes of widths."""
    i = spark.range(200).selectExpr("id", "id % 40 as k", "id as s", "id + shiftleft(1L, cast(id % 16 as int)) as e")
    p = spark.range(20000).selectExpr("id as pid", "id % 40 as k", "id % 500 as at")
    plan = interval_join(i, p, "s", "e", "at", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join" not in plan
