"""Packed day files and tile batches against direct numpy forms."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from halocline.operators import batches
from halocline.operators.windows import axis_plan
from halocline.sources import packed, packed_source


def test_slices_of_both_precisions():
    arrays = {"a": np.arange(6, dtype="<f2").reshape(1, 2, 3), "b": np.array([[1e-7, np.nan, 65504.0]], "<f4")}
    data = packed.packed(arrays)
    assert (packed.unpacked(data, ["b"])["b"].tobytes() == arrays["b"].tobytes()) and packed.unpacked(data, ["a"])["a"].tolist() == arrays["a"].tolist()
    with pytest.raises(ValueError, match="no slice c"):
        packed.unpacked(data, ["c"])
    with pytest.raises(ValueError):
        packed.unpacked(data[:-1], ["b"])


def test_days_are_pruned_and_written_twice_alike(spark, tmp_path):
    rows = [(m, date(2020, 1, k + 1), d, i, j, float(k + d + i * 10 + j) if (i + j) % 3 else None) for m in ("a", "b") for k in range(3) for d in range(2) for i in range(2) for j in range(3)]
    cells = spark.createDataFrame(rows, "model string, day date, d int, i int, j int, v double")
    root = f"file://{tmp_path}/days"
    for _ in range(2):
        done = packed.write_packed_days(cells, root, (2, 2, 3), {"v": packed.HALF}).collect()
    assert len(done) == 6 and {r.bytes for r in done} == {len(packed.packed({"v": np.zeros((2, 2, 3), "<f2")}))}
    got = packed.read_packed_days(spark, root, ["v"])
    want = sorted((m, day, d, i, j, v) for m, day, d, i, j, v in rows if v is not None)
    assert sorted(tuple(r) for r in got.collect()) == want
    one = packed.read_packed_days(spark, root, ["v"], "model = 'b' and day = '2020-01-02'")
    assert sorted(tuple(r) for r in one.collect()) == [r for r in want if r[0] == "b" and r[1] == date(2020, 1, 2)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan
    half = packed.write_packed_days(cells.withColumn("v", F.lit(0.1)), f"{root}-half", (2, 2, 3), {"v": packed.HALF})
    assert half.count() == 6 and {r.v for r in packed.read_packed_days(spark, f"{root}-half", ["v"]).collect()} == {float(np.float16(0.1))}


def test_data_source_prunes_files_and_levels(spark, tmp_path):
    rows = [(m, date(2020, 1, k + 1), d, i, j, float(k + 10 * d + i + j)) for m in ("a", "b") for k in range(4) for d in range(3) for i in range(2) for j in range(2)]
    root = f"file://{tmp_path}/days"
    packed.write_packed_days(spark.createDataFrame(rows, "model string, day date, d int, i int, j int, v double"), root, (3, 2, 2), {"v": packed.SINGLE}).count()
    packed_source.register_packed_days(spark)
    df = spark.read.format("packed_days").option("names", "v").load(root)
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    some = df.where("model = 'b' and day > '2020-01-02' and d in (0, 2) and i = 1")
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[0] == "b" and r[1] > date(2020, 1, 2) and r[2] != 1 and r[3] == 1)
    assert some.rdd.getNumPartitions() == 2
    reader = packed_source.PackedDaysReader(root, ["v"])
    left = list(reader.pushFilters([EqualTo(("i",), 1), EqualTo(("model",), "b"), In(("d",), (0, 2)), GreaterThan(("day",), date(2020, 1, 2))]))
    assert left == [EqualTo(("i",), 1)] and [(p.model, p.day.day) for p in reader.partitions()] == [("b", 3), ("b", 4)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 * 2 * 4
    assert spark.read.format("packed_days").option("names", "v").load(f"{root}-none").count() == 0
    with pytest.raises(Exception, match="needs a path and names"):
        spark.read.format("packed_days").load(root).schema


def grid(spark, ny, nx, days):
    rng = np.random.default_rng(8)
    x = rng.random((days, ny, nx)).round(3)
    y, loss = rng.random((days, ny, nx)).round(3), rng.integers(0, 2, (days, ny, nx))
    x[x < 0.1] = np.nan
    rows = [(date(2020, 1, 1) + timedelta(t), i, j, None if np.isnan(x[t, i, j]) else float(x[t, i, j]), int(not np.isnan(x[t, i, j])), float(y[t, i, j]), int(loss[t, i, j])) for t in range(days) for i in range(ny) for j in range(nx) if t != 2]
    x[2] = np.nan
    return spark.createDataFrame(rows, "day date, i int, j int, x double, m int, y double, loss int"), np.nan_to_num(x), ~np.isnan(x), y * loss, loss


@pytest.mark.parametrize("ny,nx,tile,core", [(9, 14, 6, 4), (3, 5, 8, 4)])
def test_tensors_of_tiles(spark, ny, nx, tile, core):
    cells, x, have, y, loss = grid(spark, ny, nx, 5)
    plan_i, plan_j = axis_plan(ny, tile, core), axis_plan(nx, tile, core)
    draws = [(k, date(2020, 1, 1) + timedelta(t), oi, oj) for k, (t, oi, oj) in enumerate((t, p[0], q[0]) for t in (0, 3, 4) for p in plan_i for q in plan_j)]
    draws += [(99, *draws[0][1:])]
    got = batches.tile_batches(spark.createDataFrame(draws, "draw long, day date, oi int, oj int"), cells, ["x"], {"y": "loss"}, ny, nx, tile, core, 3, ("m",)).collect()
    assert len(got) == len(draws)
    for r in got:
        t = (r.day - date(2020, 1, 1)).days
        wx, wy, wm, wc = np.zeros((3, 2, tile, tile)), np.zeros((tile, tile)), np.zeros((tile, tile)), np.zeros((tile, tile))
        h, w = min(tile, ny - r.oi), min(tile, nx - r.oj)
        own = np.s_[r.oi : r.oi + h, r.oj : r.oj + w]
        for k in range(3):
            if t - 2 + k >= 0:
                wx[k, 0, :h, :w], wx[k, 1, :h, :w] = x[t - 2 + k][own], have[t - 2 + k][own]
        wy[:h, :w], wm[:h, :w] = y[t][own], loss[t][own]
        (_, a, b), (_, c, d) = (next(p for p in plan if p[0] == o) for plan, o in ((plan_i, r.oi), (plan_j, r.oj)))
        wc[a - r.oi : b - r.oi, c - r.oj : d - r.oj] = 1
        assert np.allclose(r.x, wx.reshape(-1)) and np.allclose(r.y, wy.reshape(-1)) and r.mask == wm.reshape(-1).tolist() and r.core == wc.reshape(-1).tolist()


def test_draws_repeat_and_follow_the_chances(spark):
    days = spark.createDataFrame([(date(2020, 1, k + 1),) for k in range(4)], "day date")
    tiles = spark.createDataFrame([(0, 0, 0.7), (0, 4, 0.0), (4, 0, 0.3)], "oi int, oj int, p double")
    one, two = (sorted(map(tuple, batches.draw_tiles(d, tiles, 3000, 5).collect())) for d in (days, days.repartition(3)))
    assert one == two and len(one) == 3000 and [r[0] for r in one] == list(range(3000))
    share = {o: sum(r[2:] == o for r in one) / 3000 for o in ((0, 0), (0, 4), (4, 0))}
    assert share[0, 4] == 0 and abs(share[0, 0] - 0.7) < 0.03
    assert all(abs(sum(r[1].day == k + 1 for r in one) / 3000 - 0.25) < 0.03 for k in range(4))
    assert batches.draw_tiles(days.limit(0), tiles, 9).count() == batches.draw_tiles(days, tiles.limit(0), 9).count() == 0


def test_dev_scores(spark):
    ny, nx, tile, core = 9, 14, 6, 4
    rng = np.random.default_rng(2)
    pairs = [(date(2020, 1, 1) + timedelta(t), i, j, d, *map(float, rng.normal(0, 4, 3)), int(rng.random() < 0.7)) for t in range(3) for i in range(ny) for j in range(nx) for d in range(2)]
    schema = "day date, i int, j int, d int, mean double, log_sigma double, truth double, mask int"
    draws = [(0, date(2020, 1, 1), 0, 0), (1, date(2020, 1, 1), 0, 0), (2, date(2020, 1, 3), 3, 8)]
    df, dr = spark.createDataFrame(pairs, schema), spark.createDataFrame(draws, "draw long, day date, oi int, oj int")
    plans = axis_plan(ny, tile, core), axis_plan(nx, tile, core)
    nll, se = [], []
    for _, day, oi, oj in draws:
        (_, a, b), (_, c, e) = (next(p for p in plan if p[0] == o) for plan, o in zip(plans, (oi, oj), strict=True))
        for pday, i, j, d, mean, ls, truth, mask in pairs:
            if pday == day and a <= i < b and c <= j < e and mask:
                ls = max(-6.0, min(6.0, ls))
                nll.append(0.5 * np.log(2 * np.pi) + ls + 0.5 * ((truth - mean) / np.exp(ls)) ** 2)
                se += [(truth - mean) ** 2] if d == 1 else []
    got = batches.dev_scores(dr, df, ny, nx, tile, core, F.col("d") == 1).first()
    assert (got.n_draws, got.n) == (3, len(nll)) and got.dev_nll == pytest.approx(np.mean(nll)) and got.dev_rmse == pytest.approx(np.mean(se) ** 0.5)
    none = batches.dev_scores(dr.limit(0), df, ny, nx, tile, core, F.col("d") == 1).first()
    assert tuple(none) == (0, 0, None, None)
    zero = batches.dev_scores(dr, df.withColumn("mask", F.lit(0)), ny, nx, tile, core, F.col("d") == 1).first()
    assert tuple(zero) == (3, 0, 0.0, 0.0)
