import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import topk
from halocline.llm.topk import exact_top_k, local_bounds, sufficient

SCHEMA = "vec_id long, embedding array<float>, label int, block long, ids string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None, None) for i, v in rows], SCHEMA)


def brute(rows, is_query, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in ok:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v)
    for q, qv in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, k=5, **options):
    return sorted(tuple(r) for r in exact_top_k(table(spark, rows), F.col("vec_id") % 5 == 0, k, **options).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_vectors(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.5, -0.5]) for _ in range(12)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]  # ties
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_missing_parts_few_rows_and_repeats(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.1, None]), (2, [float("nan"), 0.0]), (3, [float("inf"), 0.0]), (4, None), (None, [1.0, 1.0]), (5, [-0.5, 0.75]), (6, [0.5, 0.25]), (6, [0.5, 0.25]), (0, [0.25, 0.25])]
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_uneven_lengths_and_large_parts(spark):
    rows = [(0, [3e6, -2e6, 1e6]), (5, [1e6]), (1, []), (2, [2e6, 2e6]), (3, [-1e6, 1e6, 1e6])]
    assert found(spark, rows, k=2) == brute(rows, lambda i: i % 5 == 0, 2)


def test_empty_table_and_one_row(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []


@pytest.mark.parametrize("skew,most", [(1.0, 1.01), (0.9, 0.5), (0.6, 0.2)])
def test_cutoffs_save_products_on_skewed_vectors(skew, most):
    """Products formed, against those of all pairs; the results are exact either way."""
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(2000, 32)) * skew ** np.arange(32)).astype(np.int64)
    q, ids = v[::50], np.arange(2000)
    lists = np.array_split(np.argsort(-(v.astype(float) ** 2).sum(axis=0)), 4)
    cut = np.array(local_bounds(q, ids[::50], v, ids, lists, 5))
    cost = 0
    for r, (rows, score, n) in enumerate(sufficient(q, v, cut, lists)):
        exact = v @ q[r]
        assert set(np.flatnonzero(exact >= cut[r])) <= set(rows) and (score == exact[rows]).all()
        cost += n
    assert cost <= most * q.size * len(v)


def test_negative_cutoffs_and_clashing_columns(spark):
    rows = [(i, [-1.0 - i / 10, -1.0] if i % 5 else [1.0, 1.0]) for i in range(12)]
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_cells_hold_a_bounded_number_of_query_blocks(spark, monkeypatch):
    """The grid grows with the queries, so that no task hashes a fixed share of them."""
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "HELD_BLOCKS", 3)
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(240)]
    asked = topk.integer_vectors(table(spark, rows).select("vec_id", "embedding"), topk.SCALE)
    blocks, others = topk._packed(asked, 2), topk._packed(asked, 16)
    pairs = topk._pairs(blocks, others)
    assert pairs.select("qb", "block").distinct().count() == pairs.count() == blocks.count() * others.count()
    held = pairs.select("row", "col", "qb").distinct().groupBy("row", "col").count().agg(F.max("count"), F.avg("count")).first()
    assert held[0] <= 12 and held[1] <= 5
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)
