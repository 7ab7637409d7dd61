"""Sketches against exact values, within their bounds."""

import math
import random

from pyspark.sql import functions as F

from halocline.operators import sketches
from halocline.sources.products import crop_to_box


def test_quantiles_stay_within_the_relative_error(spark):
    rng = random.Random(3)
    rows = [(k % 4, g, v) for k in range(6000) for g, v in [("log", math.exp(rng.gauss(0, 4))), ("mixed", rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-3, 4)), ("zero", rng.choice([0.0, 0.0, 5.0, -2.0]))]]
    rows += [(0, "log", None), (0, "log", float("nan")), (0, "log", float("inf")), (0, "none", None)]
    df = spark.createDataFrame(rows, "day int, g string, v double")
    levels = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    for error in (0.01, 0.1):
        days = sketches.value_sketch(df, ["day", "g"], "v", error)
        got = {r.g: r for r in sketches.quantiles(sketches.add_value_sketches(days.where("day < 3"), ["g"]), ["g"], levels, error).collect()}
        assert set(got) == {"log", "mixed", "zero"}
        for g, r in got.items():
            own = sorted(v for d, gg, v in rows if gg == g and d < 3 and v is not None and math.isfinite(v))
            assert r.n == len(own)
            for name, q in levels.items():
                exact = own[max(1, math.ceil(q * len(own) - 1e-9)) - 1]
                assert abs(r[name] - exact) <= error * abs(exact) * (1 + 1e-9), (g, name)


def test_distinct_counts_merge_overlapping_parts(spark):
    for n in (0, 1, 10, 3000, 60_000):
        df = spark.range(n).select((F.col("id") % 3).alias("day"), F.col("id").alias("x")).unionByName(spark.range(n).select(F.lit(7).cast("long").alias("day"), F.col("id").alias("x")))
        days = sketches.distinct_sketch(df, ["day"], "x")
        merged = sketches.distinct_count(sketches.merge_distinct_sketches(days.withColumn("all", F.lit(1)), ["all"]), ["all"]).collect()
        assert (not merged and n == 0) or abs(merged[0].distinct - n) <= 4 * 1.04 / 64 * n


def test_box_of_wrapped_longitudes_reaches_the_scan(spark, tmp_path):
    rows = [(10.0, float(lon), 1.0) for lon in (-300, -75, 50, 60, 61, 80, 250, 285, 300, 420, 421)]
    spark.createDataFrame(rows, "latitude double, longitude double, v double").write.parquet(f"{tmp_path}/p")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        df = crop_to_box(spark.read.parquet(f"{tmp_path}/p"), ["v"], check=False)
        assert sorted(r.lon for r in df.collect()) == [50.0, 60.0, 60.0, 60.0, 61.0, 61.0, 80.0]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "Or(" in pushed and pushed.count("GreaterThanOrEqual(longitude") >= 2
