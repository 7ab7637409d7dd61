"""Order statistics, distance transforms and other exact selections against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import masks, metrics
from halocline.operators.order_statistics import order_statistic


@pytest.mark.parametrize("ranges,levels", [(5, [0.9]), (4096, [0.0, 0.25, 0.9, 1.0])])
def test_order_statistic_of_any_rank(spark, ranges, levels):
    rng = random.Random(ranges)
    groups = {
        "even": [rng.random() for _ in range(300)], "one": [3.5], "same": [2.0] * 50, "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(99)], "far": [1e-300, 1.0, 1e300, -1e308, 1e308, 7.0], "scales": [10.0**k for k in range(-20, 21)],
        "none": [None, float("nan")], "some": [None, 4.0, float("nan"), 5.0], None: [1.0, 2.0, 3.0], "ends": [float("inf"), 1.0, float("-inf")],
    }
    rows = [(k, 1, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, other int, v double")
    for level in levels:
        got = {r.k: (r.n, r.v) for r in order_statistic(df, ["k", "other"], "v", level, ranges).collect()}
        for k, vs in groups.items():
            own = sorted(max(min(v, 1.7976931348623157e308), -1.7976931348623157e308) for v in vs if v is not None and not math.isnan(v))
            want = own[max(1, math.ceil(level * len(own) - 1e-9)) - 1] if own else None
            assert got[k] == (len(own), want), (k, level)
    assert order_statistic(df.limit(0), ["k"], "v", 0.5).count() == 0


def test_alpha_gathers_no_group(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("d"), (F.col("id") * 0.01).alias("mean"), F.lit(1.0).alias("sigma"), F.lit(0.0).alias("truth"))
    found = metrics.fit_alpha(df, ["d"])
    plan = found._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    for r in found.collect():
        own = sorted(abs(k * 0.01) / 1.6449 for k in range(5000) if k % 3 == r.d)
        assert r.alpha == pytest.approx(min(20.0, own[math.ceil(0.9 * len(own) - 1e-9) - 1]))


def test_lower_envelope_is_the_minimum():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        at = np.sort(rng.choice(100, n, replace=False))
        height = rng.integers(0, 900, n)
        want = np.arange(-3, 104)
        assert (masks.lower_envelope(at, height, want) == ((want[:, None] - at) ** 2 + height).min(axis=1)).all()


def test_coast_distance_of_a_fine_grid(spark):
    rng = np.random.default_rng(4)
    wet = (rng.random((37, 23)) > 0.03).astype(int)
    cells = spark.createDataFrame([(i, j, int(wet[i, j])) for i in range(37) for j in range(23)], "i int, j int, wet int")
    land = np.argwhere(wet == 0)
    got = {(r.i, r.j): r.coast_km for r in masks.coast_distance(cells).collect()}
    assert len(got) == 37 * 23
    for (i, j), km in got.items():
        assert km == pytest.approx(np.sqrt(((land - [i, j]) ** 2).sum(axis=1).min()) * 27.75)
    assert {r.coast_km for r in masks.coast_distance(cells.withColumn("wet", F.lit(1))).collect()} == {0.0}
