"""Packed day files as a data source of Spark: spark.read.format("packed_days"), a partition per file, filters pushed to files and depths."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .packed import open_folder, unpacked

_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Columns that a file, or a level of it, has one value of.
_PRUNED = ("model", "day", "d")


@dataclass
class PackedFile(InputPartition):
    path: str
    model: str
    day: date


@dataclass
class PackedDaysReader(DataSourceReader):
    root: str
    names: list[str]
    filters: list[Filter] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of model, day and d with constants are kept and decided here; Spark decides the others."""
        for f in filters:
            known = type(f) in _COMPARED or isinstance(f, In)
            if known and len(f.attribute) == 1 and f.attribute[0] in _PRUNED:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, column: str, value: object) -> bool:
        for f in self.filters:
            if f.attribute[0] == column:
                if not (value in f.value if isinstance(f, In) else _COMPARED[type(f)](value, f.value)):
                    return False
        return True

    def partitions(self) -> list[PackedFile]:
        """One per file of the models and days asked for, from the names of folders."""
        store, top = open_folder(self.root)
        found = []
        for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            parts = info.path.removeprefix(top).strip("/").split("/")
            if len(parts) == 3 and parts[2] == "fields.bin" and parts[0].startswith("model=") and parts[1].startswith("day="):
                model, day = parts[0][6:], date.fromisoformat(parts[1][4:])
                if self._wanted("model", model) and self._wanted("day", day):
                    found.append(PackedFile(info.path, model, day))
        return sorted(found, key=lambda p: (p.day, p.model))

    def read(self, partition: PackedFile) -> Iterator[pa.RecordBatch]:
        """A level at a time; levels that are not asked for are not looked at."""
        if partition is None:
            return
        store, _ = open_folder(self.root)
        with store.open_input_file(partition.path) as data:
            found = unpacked(data.read(), self.names)
        for d in range(len(next(iter(found.values())))):
            if not self._wanted("d", d):
                continue
            level = {n: a[d] for n, a in found.items()}
            have = ~np.all([np.isnan(a) for a in level.values()], axis=0)
            i, j = (pa.array(x.astype(np.int32)) for x in np.nonzero(have))
            n = len(i)
            same = [pa.array([partition.model] * n, pa.string()), pa.array([partition.day] * n, pa.date32()), pa.array(np.full(n, d, np.int32))]
            values = [pa.array(a[have].astype(np.float32), from_pandas=True) for a in level.values()]
            yield pa.RecordBatch.from_arrays([*same, i, j, *values], names=["model", "day", "d", "i", "j", *self.names])


class PackedDays(DataSource):
    """Options: path, and names, the fields to unpack, separated by commas; other slices of the files are not looked at."""

    @classmethod
    def name(cls) -> str:
        return "packed_days"

    def _names(self) -> list[str]:
        names = [n.strip() for n in self.options.get("names", "").split(",") if n.strip()]
        if not names or not self.options.get("path"):
            raise ValueError("packed_days needs a path and names")
        return names

    def schema(self) -> str:
        return "model string, day date, d int, i int, j int, " + ", ".join(f"{n} float" for n in self._names())

    def reader(self, schema: StructType) -> PackedDaysReader:
        return PackedDaysReader(self.options["path"], self._names())


def register_packed_days(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python data sources, which Spark leaves off."""
    spark.dataSource.register(PackedDays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
