"""The whole way: synthetic products, assembly into a store, features, models, evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions.dates import SplitYears
from halocline.functions.geo import Grid
from halocline.operators import align, matching, models
from halocline.plans.assemble import Assembly, assemble
from halocline.sources import synthetic
from halocline.sources.store import Store

GRID = Grid(ny=6, nx=8)
DEPTHS = (0.5, 10.0, 30.0, 60.0, 120.0, 250.0, 600.0, 1100.0)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    plan = Assembly("2015-01-01", "2018-01-31", DEPTHS, SplitYears(2016, 2017, 2018, 2019))
    fields = synthetic.product_days(spark, GRID, "2015-01-01", 1127, DEPTHS)
    calendar = align.master_calendar(spark, plan.start, plan.end)
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    return assemble(store, fields, calendar, plan), plan


def test_tables_are_complete(spark, stored):
    store, plan = stored
    assert store.complete(plan.signature)
    assert store.read("fields").count() == 1127 * GRID.ny * GRID.nx
    assert store.read("norm").count() == 22
    static = {(r.i, r.j): r for r in store.read("static").collect()}
    assert static[5, 0].wet == 0 and static[5, 0].coast_km == 0 and static[0, 0].wet == 1 and static[0, 0].coast_km > 0
    assert static[0, 0].bottom == [1] * 15 and static[0, 0].bottom_norm == 1.0


def test_training_fields_are_normalised(spark, stored):
    store, _ = stored
    r = store.read("fields").where("split = 0 and mask_sst = 1").agg(F.avg("z_sst"), F.stddev_pop("z_sst"), F.avg(F.get("z_y", F.lit(7))), F.max(F.abs("z_sst"))).first()
    assert r[0] == pytest.approx(0, abs=1e-6) and r[1] == pytest.approx(1, abs=1e-6) and r[2] == pytest.approx(0, abs=1e-6) and r[3] <= 10
    land = store.read("fields").where("i = 5").agg(F.max("mask_sst"), F.max(F.abs("z_sst")), F.count(F.get("z_y", F.lit(0)))).first()
    assert tuple(land) == (0, 0.0, 0)


def test_a_complete_store_is_not_written_again(spark, stored):
    store, plan = stored
    assert assemble(store, None, None, plan) is store


def test_without_training_days(spark, tmp_path):
    plan = Assembly("2019-01-01", "2019-01-03", DEPTHS)
    fields = synthetic.product_days(spark, GRID, "2019-01-01", 3, DEPTHS)
    with pytest.raises(ValueError, match="no training days"):
        assemble(Store(spark, f"file://{tmp_path}/s"), fields, align.master_calendar(spark, plan.start, plan.end), plan)


def test_cached_days_and_matchups(spark, stored):
    store, _ = stored
    days = store.cached_days("fields", "2016-02-01", "2016-02-03")
    assert days.count() == 3 * GRID.ny * GRID.nx
    days.unpersist()
    m = matching.build_matchups(synthetic.float_profiles(spark, GRID, "2015-01-01", 365), GRID).collect()
    assert len(m) == 200 and all(0 <= r.cell_i < 6 and 0 <= r.cell_j < 8 and r.t_100 is not None for r in m)


def test_boosted_trees_learn(spark, stored):
    store, _ = stored
    rows = store.read("fields").where("mask_sst = 1").select("split", *[f"z_{v}" for v in ("sst", "sla", "wnd_u")], F.get("z_y", F.lit(3)).alias("t_20"))
    names = ("z_sst", "z_sla", "z_wnd_u")
    fitted = models.train_depth_models(rows.where("split = 0"), ["t_20"], names, trees=5, depth=4)
    models.check_models(fitted)
    r = models.score_depth_models(rows.where("split = 1"), fitted, names).agg(F.avg((F.col("t_20") - F.col("pred_t_20")) ** 2), F.avg(F.col("t_20") ** 2)).first()
    assert r[0] < 0.2 * r[1]


def proto(field, payload):
    """One length-delimited or integer field of a protocol buffer."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(payload, int):
        return varint(field << 3) + varint(payload)
    return varint(field << 3 | 2) + varint(len(payload)) + payload


def linear_network(weights):
    """An ONNX model y = x W, written out by hand."""
    tensor = b"".join(proto(1, d) for d in weights.shape) + proto(2, 1) + proto(8, b"w") + proto(9, weights.astype("<f4").tobytes())
    node = proto(1, b"x") + proto(1, b"w") + proto(2, b"y") + proto(4, b"MatMul")
    value = lambda name, width: proto(1, name) + proto(2, proto(1, proto(1, 1) + proto(2, proto(1, proto(2, b"n")) + proto(1, proto(1, width)))))
    graph = proto(1, node) + proto(2, b"g") + proto(5, tensor) + proto(11, value(b"x", weights.shape[0])) + proto(12, value(b"y", weights.shape[1]))
    return proto(1, 8) + proto(7, graph) + proto(8, proto(1, b"") + proto(2, 13))


def test_network_scores(spark, tmp_path):
    w = np.arange(6, dtype=float).reshape(3, 2)
    (tmp_path / "net.onnx").write_bytes(linear_network(w))
    rows = spark.createDataFrame([(k, [float(k), 1.0, -1.0]) for k in range(20)], "id long, x array<double>")
    got = {r.id: r.y for r in models.score_network(rows, str(tmp_path / "net.onnx"), "x", {"y": 2}, ["id"]).collect()}
    assert got == {k: pytest.approx((np.array([k, 1.0, -1.0]) @ w).tolist()) for k in range(20)}
