"""Packed day files: the fields of a model's day as named slices of one binary file, in half or single precision."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

HALF, SINGLE = "<f2", "<f4"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all workers reach, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """The length of a header, the header (JSON: each slice's offset, shape and type), and the slices."""
    slices, at = {}, 0
    for name, a in arrays.items():
        slices[name] = {"offset": at, "shape": list(a.shape), "type": a.dtype.str}
        at += a.nbytes
    header = json.dumps(slices).encode()
    return struct.pack("<I", len(header)) + header + b"".join(a.tobytes() for a in arrays.values())


def unpacked(data: bytes, names: list[str]) -> dict[str, np.ndarray]:
    """The named slices alone; ValueError if the file lacks one or is cut off."""
    (size,) = struct.unpack_from("<I", data)
    slices = json.loads(data[4 : 4 + size])
    out = {}
    for name in names:
        if name not in slices:
            raise ValueError(f"no slice {name} among {sorted(slices)}")
        s = slices[name]
        out[name] = np.frombuffer(data, s["type"], int(np.prod(s["shape"])), 4 + size + s["offset"]).reshape(s["shape"])
    return out


def write_packed_days(cells: DataFrame, root: str, shape: tuple[int, int, int], kinds: dict[str, str]) -> DataFrame:
    """cells (model, day, d, i, j, values) -> a file a model and day below root; (model, day, bytes) of what was written.

    kinds: value -> HALF or SINGLE. Values are in row-major order of depth, row and column; missing ones, and cells without a row, are NaN. A group is one
    day's grid. A file is written under a name of its own and then moved, so that a task may run twice.
    """
    _, height, width = shape

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place = ((rows["d"].to_numpy(np.int64) * height + rows["i"].to_numpy(np.int64)) * width) + rows["j"].to_numpy(np.int64)
        arrays = {}
        for name, kind in kinds.items():
            a = np.full(shape, np.nan, kind)
            a.reshape(-1)[place] = rows[name].to_numpy(np.float64)
            arrays[name] = a
        data = packed(arrays)
        store, top = open_folder(root)
        folder = f"{top}/model={key[0]}/day={key[1]}"
        store.create_dir(folder, recursive=True)
        own = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(data)
        store.move(own, f"{folder}/fields.bin")
        return pd.DataFrame({"model": [key[0]], "day": [key[1]], "bytes": [len(data)]})

    return written(cells.select("model", "day", "d", "i", "j", *kinds).groupBy("model", "day").applyInPandas(pack, "model string, day date, bytes long"), "packed-days")


def read_packed_days(spark: SparkSession, root: str, names: list[str], where: str | None = None) -> DataFrame:
    """(model, day, d, i, j, names as float): a row per cell that has any of the values; NaN is NULL.

    where: a condition on model and day, by which folders are left out before any file is read. A file is unpacked by one task, and only
    the slices asked for are looked at.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(root)
    files = files.where(where) if where else files
    columns = ["d", "i", "j"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = unpacked(b.column(2)[k].as_py(), names)
                have = ~np.all([np.isnan(a) for a in found.values()], axis=0)
                index = [pa.array(x.astype(np.int32)) for x in np.nonzero(have)]
                values = [pa.array(a[have].astype(np.float32), from_pandas=True) for a in found.values()]
                same = [pa.array([b.column(c)[k].as_py()] * len(index[0]), b.column(c).type) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, *index, *values], names=["model", "day", *columns, *names])

    schema = "model string, day date, d int, i int, j int, " + ", ".join(f"{n} float" for n in names)
    return files.select(F.col("model").cast("string"), F.col("day").cast("date"), "content").mapInArrow(unpack, schema)
