"""The store: Parquet tables partitioned by month, with a signature that tells a complete store from a partial one."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables below one root. Writing a range of days replaces its months only, so writers of disjoint months don't meet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write_days(self, table: str, df: DataFrame) -> None:
        """df (day, ...): partitioned by month and sorted, so that scans prune by day and cell.

        Rows are dealt out by day, which holds a grid at most: a large month is written by up to 31 tasks, as many files.
        """
        out = df.withColumn("month", F.date_format("day", "yyyy-MM"))
        by = [c for c in ("day", "i", "j") if c in df.columns]
        out.repartition("day").sortWithinPartitions("month", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.path(table))

    def write_table(self, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def read_days(self, table: str, start: str, end: str) -> DataFrame:
        """Only the months and days asked for."""
        from .products import month_keys

        df = self.read(table).where(F.col("month").isin(*month_keys(start, end)))
        return df.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).drop("month")

    def cached_days(self, table: str, start: str, end: str) -> DataFrame:
        """A range of days kept by the executors, in memory and on disk, for repeated reads; lost parts are read again."""
        return self.read_days(table, start, end).persist(StorageLevel.MEMORY_AND_DISK)

    def write_meta(self, **values: str) -> None:
        self.write_table("_meta", self.spark.createDataFrame(sorted(values.items()), "key string, value string"))

    def meta(self) -> dict[str, str]:
        """A handful of pairs."""
        return {r.key: r.value for r in self.read("_meta").collect()}

    def exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/_SUCCESS")
        return bool(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at))

    def complete(self, signature: str) -> bool:
        """Whether the store was finished for this configuration."""
        return self.exists("_meta") and self.meta().get("signature") == signature and self.meta().get("complete") == "true"

    def months(self, table: str) -> DataFrame:
        """(month) of what is there, from partition names alone."""
        return self.read(table).select("month").distinct()


def signature(*parts: Column | str) -> Column:
    """SHA-256 of a configuration's parts."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def done_months(manifest: DataFrame, product: str) -> DataFrame:
    """(month) that a product's manifest (product, month) lists."""
    return manifest.where(F.col("product") == product).select("month").distinct()


def missing_months(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """wanted (product, month) that the manifest lacks: an anti-join makes a run resumable."""
    return wanted.join(manifest, ["product", "month"], "left_anti")
