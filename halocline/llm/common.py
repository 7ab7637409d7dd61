"""Helpers shared by the text operators: shared folder, written tables, tokenisers, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: everything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that split alphanumeric words: all of ASCII but digits and letters.
_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Rows of an Arrow batch handed to Python; texts are long, so the batches are short.
BATCH_ROWS = 1000
#: Bytes after which an Arrow batch ends, whatever its rows: segments of an index are a few MB each.
BATCH_BYTES = 16 << 20

#: Bits of the filter that tells which rows a decision may concern: 16 MB, whatever the number of decisions.
FILTER_BITS = 1 << 27

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in local mode a temporary one if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            _own_dirs[app] = tempfile.mkdtemp(prefix="halocline-")
        path = _own_dirs[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends here and survives lost executors.

    group_rows: rows of a row group at most. A row group is written and read as a whole, so that tables of rows of
    several MB need a bound that does not grow with the rows of a task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    options = {} if group_rows is None else {"parquet.block.row.count.limit": str(group_rows)}
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """(slot, bits): which of FILTER_BITS values the hashes of the keys take, as at most FILTER_BITS / 32768 bitmaps of 4 KB.

    However many keys there are, the result is FILTER_BITS / 8 bytes at most, so it may be broadcast.
    """
    at = keys.select((F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def maybe_among(rows: DataFrame, key: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among those of key_bits, rows whose key is not). The first gain a column _key."""
    at = F.pmod(F.xxhash64("_key"), F.lit(FILTER_BITS)) + 1
    own, place = rows.columns, F.bitmap_bit_position("at").cast("int")
    keyed = rows.select(F.struct("*").alias("_own"), key.alias("_key")).withColumn("at", at)
    joined = keyed.join(F.broadcast(bits), F.bitmap_bucket_number("at") == F.col("slot"), "left")  # FILTER_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    mine = [F.col(f"_own.`{c}`") for c in own]
    return joined.where(hit).select("_own", "_key"), joined.where(~hit).select(*mine)


def without_rows(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows whose key is not in keys (a written table with the column `name`).

    Most rows are told apart by a bitmap of fixed size and stay where they are; only those that may be among the keys are
    shuffled to the keys, whose partitions are hashed, so that long rows need not be sorted.
    """
    may, free = maybe_among(rows, key, key_bits(keys, name))
    exact = may.join(keys.select(F.col(name).alias("_key")).hint("shuffle_hash"), "_key", "left_anti")
    return free.unionByName(exact.select(*[F.col(f"_own.`{c}`") for c in rows.columns]))


def only_rows(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows whose key is in keys (a written table); the others are not shuffled."""
    may, _ = maybe_among(rows, key, key_bits(keys, name))
    exact = may.join(keys.select(F.col(name).alias("_key")).hint("shuffle_hash"), "_key", "left_semi")
    return exact.select(*[F.col(f"_own.`{c}`") for c in rows.columns])


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts and of segments small unless the session has set its own bounds."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidied(run):
    """A function of Arrow batches that, once its task is done, hands memory it no longer holds back to the system.

    Workers serve one task after another, and what their allocators keep adds to the executor's memory.
    """

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
            if trim:
                trim(0)

    return tidy


def row_key(*cols: Column | str) -> Column:
    """Two equal rows have one key; used to join decisions back when ids may be null or repeat."""
    return F.xxhash64(*cols)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII strings take the fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, lower))


def words_of(text: bytes) -> list[bytes]:
    """bytes.split() splits at exactly space and \\x09-\\x0D."""
    return text.split()


def alnum_words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(_ALNUM).split()


#: Words that a worker keeps looked up; what it looks up anew is cheap, and its memory adds to the executor's.
KEPT_WORDS = 50_000


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it grows beyond a bound, so memory stays bounded."""

    def __init__(self, seed: int = 0, bound: int = 500_000):
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(2 * n + 2, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes, so that every bit depends on all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes: a polynomial modulo 2^64 from prefix sums, then mixed."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    power, inverse = _grown(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    return mixed((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1])


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in any of the given intervals."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + lengths, n), -1)
    return np.cumsum(marks[:n]) > 0


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component = smallest node reachable), by alternating large-star and small-star.

    Each round groups with map-side minima and joins written tables, so AQE can split a hub's rows; rounds are
    logarithmic in the size of the largest component. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct()
    edges = written(edges, "cc-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mins = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-mins")
        large = both.join(mins, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(large.where("a != b").distinct(), "cc-edges")
        mins = written(edges.groupBy("a").agg(F.min("b").alias("m")), "cc-mins")
        small = edges.join(mins, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(mins.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def prefix_sums(df: DataFrame, order: list[str], sums: list[str], partitions: int | None = None) -> DataFrame:
    """Adds before_<c>: the sum of c over all rows that come before in the order (nulls last), for each c in sums.

    Rows are range-partitioned and sorted, each partition adds up on its own, and one total per partition is
    carried over. No task sees more than its range; only as many rows as partitions meet in one place.
    """
    from pyspark import TaskContext

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() for c in order]
    schema = df.schema
    for c in sums:
        schema = schema.add(f"before_{c}", "double" if dict(df.dtypes)[c] == "double" else "long")
    schema = schema.add("_part", "integer").add("_last", "boolean")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total = {c: 0 for c in sums}

        def done(columns: list, last: bool) -> pa.RecordBatch:
            ends = np.zeros(len(columns[0]), bool)
            ends[-1] = last
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(ends)], names=names)

        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = list(b.columns)
            for c in sums:
                v = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                up_to = np.cumsum(v)
                columns.append(pa.array(total[c] + up_to - v))
                total[c] += up_to[-1]
            if kept is not None:
                yield done(kept, False)
            kept = columns
        if kept is not None:
            yield done(kept, True)

    names = schema.names
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = written(ranged.mapInArrow(tidied(local), schema), "prefix")
    ends = rows.where("_last").select("_part", *[(F.col(f"before_{c}") + F.col(c)).alias(f"_end_{c}") for c in sums])
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_part", *[F.coalesce(F.sum(f"_end_{c}").over(up_to), F.lit(0)).alias(f"_from_{c}") for c in sums])
    joined = rows.join(F.broadcast(offsets), "_part")  # one row per partition of the sort
    for c in sums:
        joined = joined.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"_from_{c}"))
    return joined.drop("_part", "_last", *[f"_from_{c}" for c in sums])
