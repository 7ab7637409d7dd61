"""Days of an event stream that a watermark closes, in append mode with bounded state, and the rows that came too late for them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .twins import SUMS, daily_sums


def day_end(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.expr("interval 1 day")


class DayLedger:
    """Events that arrive in pieces, kept below one folder: additive sums of closed days, and late rows.

    A day is closed, and its sums are written once, when the newest event is `late` past its end; Spark then drops it from the state,
    which holds open days alone. A row whose day is closed as it arrives counts nowhere but is kept among the late rows. Both
    follow from the pieces that came before, so runs that are repeated after a failure, or go on in another session, agree: offsets,
    state and sinks are in the folder.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], value: str = "value", late: str = "3 days"):
        self.spark, self.root, self.schema, self.keys, self.value, self.late = spark, root.rstrip("/"), schema, keys, value, late

    def _stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.root}/in")

    def _read(self, table: str, schema: StructType, **options: str) -> DataFrame:
        return self.spark.read.schema(schema).options(**options).parquet(f"{self.root}/{table}")

    def arrive(self, events: DataFrame) -> None:
        """Takes in a piece (ts timestamp, keys, value, ...), which must have the ledger's schema."""
        events.select(*self.schema.names).write.mode("append").parquet(f"{self.root}/in")
        self.run()

    def run(self) -> None:
        """Handles what has arrived; a piece that came while a run failed is handled by the next."""
        self._sums_query().awaitTermination()
        self._late_query().awaitTermination()

    def _sums_query(self) -> StreamingQuery:
        sums = daily_sums(self._stream(), self.keys, self.value, self.late)
        to = sums.writeStream.outputMode("append").format("parquet").option("path", f"{self.root}/closed")
        return to.option("checkpointLocation", f"{self.root}/state/closed").trigger(availableNow=True).start()

    def _late_query(self) -> StreamingQuery:
        mark = StructType().add("top", "timestamp")

        def split(piece: DataFrame, batch: int) -> None:
            # a batch's folder is overwritten when it is run again, and a mark covers all batches up to it
            piece = piece.where("ts is not null")
            before = self.spark.createDataFrame([], mark) if batch == 0 else self._read(f"marks/{batch - 1}", mark)
            top = before.agg(F.max("top").alias("_top"))  # one row
            # Spark keeps watermarks in milliseconds
            passed = F.date_trunc("millisecond", F.col("_top")) - F.expr(f"interval {self.late}")
            piece.join(F.broadcast(top)).where(day_end(F.col("ts")) <= passed).drop("_top").write.mode("overwrite").parquet(f"{self.root}/late/{batch}")
            tops = piece.agg(F.max("ts").alias("top")).unionByName(before)
            tops.agg(F.max("top").alias("top")).write.mode("overwrite").parquet(f"{self.root}/marks/{batch}")

        to = self._stream().writeStream.foreachBatch(split).option("checkpointLocation", f"{self.root}/state/late")
        return to.trigger(availableNow=True).start()

    def closed(self) -> DataFrame:
        """(day, keys, n, s, ss), a row per closed day and key."""
        schema = StructType().add("day", "date")
        for k in self.keys:
            schema = schema.add(self.schema[k])
        for c in SUMS:
            schema = schema.add(c, "long" if c == "n" else "double")
        return self._read("closed", schema)

    def late_rows(self) -> DataFrame:
        """All rows that came after their day was closed, as they were."""
        return self._read("late", self.schema, recursiveFileLookup="true")


def new_ledger(spark: SparkSession, folder: str, schema: StructType, keys: list[str], value: str = "value", late: str = "3 days") -> DayLedger:
    return DayLedger(spark, f"{folder.rstrip('/')}/ledger-{uuid.uuid4().hex}", schema, keys, value, late)
