"""Streams of events: daily means, sessions, sliding windows and running statistics, equal to their batch forms on bounded input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SUMS = ("n", "s", "ss")


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream over a folder or file of events; ts as a time-zoned timestamp, which watermarks need.

    The path's last character is given as a glob: a stream takes a plain path for a folder, and a single file would not do.
    """
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_sums(events: DataFrame, keys: list[str], value: str = "value", late: str = "60 days") -> DataFrame:
    """Tumbling days: additive n, s, ss per key.

    In append mode a day is given once, when the newest event is `late` past its end, and rows that come after that are dropped
    (closing.DayLedger keeps them apart). In complete mode, as drained() runs it, all days stay in the state and no row is dropped.
    """
    v = F.col(value).cast("double")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), *keys)
    return grouped.agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")).select(F.to_date("w.start").alias("day"), *keys, *SUMS)


def sliding_means(events: DataFrame, keys: list[str], size: str = "3 days", slide: str = "1 day", value: str = "value", late: str = "60 days") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), *keys)
    return grouped.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), *keys, "mean", "n")


def sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = "60 days") -> DataFrame:
    """(key, start, end, n): runs of a key's events with pauses shorter than gap."""
    grouped = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_stats(events: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, n, mean, std) after each trigger: state of three sums a key, kept by Spark's state store."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, ss = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in batches:
            v = pdf[value].dropna().astype(float)
            n, s, ss = n + len(v), s + float(v.sum()), ss + float((v * v).sum())
        state.update((n, s, ss))
        std = max(ss / n - (s / n) ** 2, 0.0) ** 0.5 if n else None
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [s / n if n else None], "std": [std]})

    kind = dict(events.dtypes)[key]
    return events.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double, std double", "n long, s double, ss double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all input that is there and returns its last result.

    The sink is Parquet in the checkpoint's folder, one sub-folder per batch, so no result passes through the driver. complete: the
    last batch is the result; update: later rows of a batch replace earlier ones, which callers resolve by _batch.
    """
    spark = stream.sparkSession
    root = f"{checkpoint.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/{batch:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    schema = stream.schema.add("_batch", "integer")
    if last is None:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    if mode != "complete":
        return out
    newest = out.agg(F.max("_batch")).first()[0]
    return out.where(F.col("_batch") == newest).drop("_batch")


def merged_sums(batches: Callable[[], DataFrame], keys: list[str]) -> DataFrame:
    """Additive sums of several micro-batches, added up."""
    return batches().groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
