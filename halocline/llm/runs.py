"""Levelled sorted runs: the log-structured index that line dedup and substring dedup share."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path


class SortedRuns:
    """Immutable runs of (keys, values), one row per key, each bucketed and sorted by its keys below one folder.

    add() merge-joins a batch with the runs, so that keys which no run holds are told apart, and writes it as a run of
    level 0. When a level holds `fanout` runs they are merged into one run of the next level. Batches are hashed into the
    runs' buckets, so the history is neither moved nor sorted again. A manifest below the folder lists the levels:
    open() finds them again, in another session too. merge: for each value column the aggregate that combines entries of one key.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], merge: dict[str, str], fanout: int = 4, path: str | None = None):
        self.spark, self.name, self.keys, self.merge, self.fanout = spark, name, keys, merge, fanout
        self.path = path or new_path(spark, name)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.columns: list[str] = []
        self.levels: list[list[str]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SortedRuns:
        """The index that an earlier session has left below path."""
        last = spark.read.schema("version int, state string").parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        state = json.loads(last.state)
        runs = cls(spark, state["name"], state["keys"], state["merge"], state["fanout"], path)
        runs.version, runs.columns, runs.buckets = last.version, state["columns"], state["buckets"]
        runs.levels = [[runs._table(run) for run in level] for level in state["levels"]]
        return runs

    def _table(self, run: str) -> str:
        """The table of a written run; a session that has not written it declares it."""
        table = f"{self.name}_{run}"
        if not self.spark.catalog.tableExists(table):
            keys = ", ".join(self.keys)
            self.spark.sql(f"CREATE TABLE {table} ({', '.join(self.columns)}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return table

    def _save(self) -> None:
        self.version += 1
        levels = [[t.removeprefix(f"{self.name}_") for t in level] for level in self.levels]
        state = {"name": self.name, "keys": self.keys, "merge": self.merge, "fanout": self.fanout, "buckets": self.buckets, "columns": self.columns, "levels": levels}
        row = self.spark.createDataFrame([(self.version, json.dumps(state))], "version int, state string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, df: DataFrame) -> str:
        run = uuid.uuid4().hex
        self.columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
        writer = df.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.path}/{run}")
        writer.saveAsTable(f"{self.name}_{run}", format="parquet")
        return f"{self.name}_{run}"

    def _merge_two(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Merge-joins two runs; both are bucketed alike, so nothing is shuffled."""
        combine = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
        a, b = left.alias("a"), right.hint("merge").alias("b")
        on = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in self.keys])
        keys = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in self.keys]
        values = [combine[how](F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c, how in self.merge.items()]
        return a.join(b, on, "full_outer").select(*keys, *values)

    def merged(self, tables: list[str]) -> DataFrame:
        """One row per key. Runs are merged pairwise, so that each row takes part in a logarithmic number of merges."""
        found = [self.spark.table(t).select(*self.keys, *self.merge) for t in tables]
        while len(found) > 1:
            found = [self._merge_two(*found[k : k + 2]) if k + 1 < len(found) else found[k] for k in range(0, len(found), 2)]
        return found[0]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in reversed(self.levels) for t in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Merge-anti-joins the batch with every run."""
        return reduce(lambda left, run: left.join(run.select(*self.keys).hint("merge"), self.keys, "left_anti"), self.runs(), batch)

    def seen(self, batch: DataFrame) -> DataFrame:
        """What unseen() leaves out."""
        if not self.levels:
            return batch.limit(0)
        keys = reduce(DataFrame.unionByName, [batch.select(*self.keys).join(run.select(*self.keys).hint("merge"), self.keys, "left_semi") for run in self.runs()])
        return batch.join(keys, self.keys, "left_semi")

    def add(self, entries: DataFrame) -> DataFrame:
        """entries (one row per key) become a run; returned are the entries with `seen`: whether an earlier run holds the key."""
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            entries = entries.repartition(self.buckets, *self.keys)
        marked, marks = entries.select(*self.keys, *self.merge), []
        for k, run in enumerate(self.runs()):
            held = run.select(*self.keys, F.lit(True).alias(f"_in{k}")).hint("merge")
            marked, marks = marked.join(held, self.keys, "left"), [*marks, F.col(f"_in{k}")]
        seen = F.coalesce(*marks, F.lit(False)) if marks else F.lit(False)
        table = self._write(marked.select(*self.keys, *self.merge, seen.alias("seen")))
        found = self.spark.read.schema(self.spark.table(table).schema).parquet(f"{self.path}/{table.removeprefix(f'{self.name}_')}")
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(table)
            if len(self.levels[level]) < self.fanout:
                break
            table = self._write(self.merged(self.levels[level]).withColumn("seen", F.lit(False)))
            self._drop(self.levels[level])
            self.levels[level] = []
            level += 1
        self._save()
        return found

    def totals(self, keys: DataFrame) -> DataFrame:
        """The merged entries of the given keys alone (a written table, one row per key), whatever the size of the history."""
        own = keys.select(*self.keys)
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            own = own.repartition(self.buckets, *self.keys)
        parts = [own.join(run.select(*self.keys, *self.merge).hint("merge"), self.keys) for run in self.runs()]
        how = {"sum": F.sum, "max": F.max, "min": F.min}
        return reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(*[how[h](c).alias(c) for c, h in self.merge.items()])

    def compact(self) -> DataFrame:
        """All runs merged: one row per key. At least one run must have been added."""
        return self.merged([t for level in reversed(self.levels) for t in level])

    def _drop(self, tables: list[str]) -> None:
        """Forgets merged runs; their files stay until the folder is cleared, for tasks that may still read them."""
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")

    def close(self) -> None:
        """Forgets the tables; files and manifest stay, so that open() finds the index again."""
        for level in self.levels:
            self._drop(level)
        self.levels = []
