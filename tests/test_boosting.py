"""Leaf-wise boosted trees against a direct form that splits one leaf at a time over all thresholds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import boosting
from halocline.operators.boosting import UNIT


def data(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.random(n).round(2), rng.integers(0, 2, n), np.full(n, 3.0)], axis=1).astype(float)
    y = (x[:, 0] > 5) * 3.0 + np.sin(x[:, 1] * 6) + x[:, 2] * (x[:, 0] < 3) + rng.normal(0, 0.1, n)
    rows = [(*map(float, r), float(t) if k % 9 else None) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), x, y


def brute(x, y, cuts, trees, leaves, rate, least):
    """Predictions for all rows; trained on rows 1.. whose index is no multiple of 9."""
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    use = np.arange(len(x)) % 9 != 0
    t = np.round(y * UNIT)
    start = math.floor(t[use].sum() / use.sum() + 0.5)
    pred = np.full(len(x), start, np.int64)
    for _ in range(trees):
        g = pred - t.astype(np.int64)
        leaf = np.zeros(len(x), int)
        for number in range(1, leaves):
            best = (0.0,)
            for k in range(number):
                own = use & (leaf == k)
                whole = float(g[own].sum()) ** 2 / own.sum()
                for f in range(x.shape[1]):
                    for b in range(len(cuts[f])):
                        left = own & (bins[:, f] <= b)
                        nl, nr = left.sum(), own.sum() - left.sum()
                        if min(nl, nr) >= least:
                            gl, gr = float(g[left].sum()), float(g[own].sum() - g[left].sum())
                            gain = gl * gl / nl + gr * gr / nr - whole
                            if gain > best[0]:
                                best = (gain, k, f, b)
            if len(best) == 1:
                break
            _, k, f, b = best
            leaf[(leaf == k) & (bins[:, f] > b)] = number
        for k in range(leaf.max() + 1):
            own = use & (leaf == k)
            pred[leaf == k] += math.floor(-int(g[own].sum()) * rate / int(own.sum()) + 0.5)
    return pred / UNIT


@pytest.mark.parametrize("trees,leaves,least", [(2, 2, 1), (2, 7, 20), (1, 20, 5)])
def test_splits_are_those_of_one_leaf_at_a_time(spark, trees, leaves, least):
    df, x, y = data(spark)
    features = ["a", "b", "c", "d"]
    cuts = boosting.even_cuts(df, features, 10)
    fitted = boosting.fit_booster(df, "y", features, cuts, trees, leaves, 0.3, least)
    fitted.check()
    got = {(r.a, r.b, r.c): r.p for r in fitted.predict(df, "p").collect()}
    want = brute(x, y, cuts, trees, leaves, 0.3, least)
    for row, p in zip(x, want, strict=True):
        assert got[tuple(row[:3])] == pytest.approx(p, abs=1e-12)
    assert all(t.leaves() <= leaves for t in fitted.trees)


def test_learns_and_does_not_depend_on_partitions(spark):
    df, _, y = data(spark, 900, 4)
    features = ["a", "b", "c", "d"]
    cuts = boosting.quantile_cuts(df, features, 32)
    one, two = (boosting.fit_booster(d, "y", features, cuts, 4, 8, 0.6) for d in (df, df.repartition(5)))
    assert one == two and len(one.trees) == 4
    error = lambda m, d: m.predict(d.where("y is not null"), "p").agg(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert error(one, df) < 0.2 * np.var(y)


def test_missing_values_few_rows_and_no_rows(spark):
    rows = [(None if k % 2 else float(k), float(k % 2) * 10) for k in range(12)]
    df = spark.createDataFrame(rows, "a double, y double")
    fitted = boosting.fit_booster(df, "y", ["a"], boosting.even_cuts(df, ["a"], 4), 1, 2, 1.0)
    # a quarter of the rows is the least a leaf keeps; missing values go right
    assert {r.p for r in fitted.predict(df.where("a is null"), "p").collect()} != {r.p for r in fitted.predict(df.where("a < 4"), "p").collect()}
    none = boosting.fit_booster(df.limit(0), "y", ["a"], boosting.even_cuts(df.limit(0), ["a"], 4))
    assert {r.p for r in none.predict(df, "p").collect()} == {0.0}
    with pytest.raises(ValueError):
        none.check()
