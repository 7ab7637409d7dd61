"""Joins on time: the last row at or before another's, and intervals of any width with the instants in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Instants of a part of an interval join, and those that are looked at to find its bounds.
PART_ROWS = 1_000_000
PER_PART = 50
#: Pairs that a task hands on at once.
PAIRS = 1 << 16


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str], forward: bool = False, tolerance: Column | None = None, partitions: int | None = None) -> DataFrame:
    """left plus, of the right rows with equal keys, the last one at or before a left row's time: carry and right_time.

    forward: the first at or after it instead. Of right rows of one time the one with the greatest carry columns counts. tolerance: a condition on time and
    right_time (such as a largest gap) without which nothing is joined. Left rows without such a row, with a null key or a null time get NULLs; rows that repeat are
    joined each.

    Both sides are range-partitioned and sorted by key and time, so that a key with most of the rows is dealt to many tasks. Each task fills
    downwards, with one row held back; a key that began in an earlier partition takes the last right row of the partitions before, of which
    each gives one.
    """
    spark = left.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(right.dtypes)
    keyed = [F.col(k).alias(f"_k{p}") for p, k in enumerate(keys)]
    names = [f"_k{p}" for p in range(len(keys))]
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    held = F.struct(F.col(time).alias("right_time"), *[F.col(c) for c in carry])
    typed = f"struct<right_time: {kinds[time]}{''.join(f', `{c}`: {kinds[c]}' for c in carry)}>"
    rows = left.select(*keyed, F.col(time).alias("_t"), own.alias("_own"), F.lit(None).cast(typed).alias("_held"))
    known = right.where(F.col(time).isNotNull()).select(*keyed, F.col(time).alias("_t"), F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"), held.alias("_held"))
    both = rows.unionByName(known)
    order = [F.col(c).asc_nulls_first() for c in names] + ([F.col("_t").desc_nulls_first()] if forward else [F.col("_t").asc_nulls_first()]) + [F.col("_held").isNull(), F.col("_held")]
    sorted_ = both.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = both.drop("_t").schema.add("_part", "integer").add("_open", "boolean").add("_end", "boolean")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, opened, some = None, True, False

        def give(b: pa.Table, ends: bool, open_: np.ndarray) -> Iterator[pa.RecordBatch]:
            flags = {"_part": np.full(b.num_rows, part, np.int32), "_open": open_, "_end": np.full(b.num_rows, ends)}
            columns = {c: b[c] for c in b.column_names} | {c: pa.array(v) for c, v in flags.items()}
            yield from pa.table(columns).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            t = pa.table({c: batch.column(c) for c in batch.schema.names if c != "_t"})
            if last is not None:
                t = pa.concat_tables([last, t])
            places = np.arange(t.num_rows)
            # where another key begins; null keys are equal to nothing
            begins = np.zeros(t.num_rows, bool)
            for c in names:
                col = t[c].combine_chunks()
                begins[1:] |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False)
            here = np.maximum.accumulate(np.where(begins, places, 0))
            holds = t["_held"].is_valid().to_numpy()
            at = np.maximum.accumulate(np.where(holds, places, -1))
            missing = at < here
            # rows of the partition's first key may have theirs in a partition before
            first = opened & (here == 0)
            mine = np.flatnonzero(~holds & (t["_own"].is_valid().to_numpy()))
            filled = t["_held"].combine_chunks().take(pa.array(at, mask=missing))
            out = t.set_column(t.schema.get_field_index("_held"), "_held", filled)
            yield from give(out.take(mine), False, (missing & first)[mine])
            opened = bool(first[-1])
            # the last row alone goes over to the next batch: its key, and the right row that it would take
            last = pa.table({c: pa.nulls(1, t[c].type) if c == "_own" else out[c].slice(t.num_rows - 1, 1) for c in t.column_names})
        if some:
            yield from give(last, True, np.array([opened]))

    done = written(sorted_.mapInArrow(fill, schema), "asof")
    # a row a partition: its last key, with the right row that holds at its end
    ends = done.where("_end").select(*names, "_part", F.lit(0).alias("_s"), "_held")
    asked = done.where("_open and not _end").select(*names, "_part").distinct().select(*names, "_part", F.lit(-1).alias("_s"), F.lit(None).cast(typed).alias("_held"))
    upto = Window.partitionBy(*names).orderBy("_part", "_s")
    found = ends.unionByName(asked).withColumn("_from", F.last("_held", True).over(upto)).where("_s = -1").drop("_held", "_s")
    left_rows = done.where("not _end")
    joined = left_rows.join(F.broadcast(found.withColumnsRenamed({c: f"{c}_" for c in names})), (F.col("_open")) & (left_rows["_part"] == found["_part"]) & F.expr(" and ".join(f"{c} = {c}_" for c in names) or "true"), "left")  # a row a partition
    holds = F.coalesce(F.col("_held"), F.col("_from"))
    out = joined.select("_own", F.when(F.expr(" and ".join(f"{c} is not null" for c in [*names, f"_own.`{time}`"])), holds).alias("_held"))
    flat = out.select(*[F.col(f"_own.`{c}`").alias(c) for c in left.columns], F.col("_held.right_time").alias("right_time"), *[F.col(f"_held.`{c}`").alias(c) for c in carry])
    if tolerance is None:
        return flat
    return flat.select(*left.columns, *[F.when(tolerance, F.col(c)).alias(c) for c in ["right_time", *carry]])


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str], gap, partitions: int | None = None) -> DataFrame:
    """left plus right_time and carry of the right row nearest in time with equal keys, the earlier of two equally near. No gap is too large.

    gap(a, b): how far b is behind a, as a number. An as-of join in each direction; nulls as in asof_join.
    """
    before = asof_join(left, right, keys, time, carry, partitions=partitions)
    named = [*left.columns, F.struct("right_time", *carry).alias("_before")]
    both = asof_join(before.select(*named), right, keys, time, carry, forward=True, partitions=partitions)
    back, on = F.col("_before.right_time"), F.col("right_time")
    earlier = on.isNull() | (back.isNotNull() & (gap(back, F.col(time)) <= gap(F.col(time), on)))
    return both.select(*left.columns, *[F.when(earlier, F.col(f"_before.`{c}`")).otherwise(F.col(c)).alias(c) for c in ("right_time", *carry)])


def _place(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, after: bool) -> np.ndarray:
    """Where each x belongs within values[lo:hi], which are sorted: before equal values, or after them."""
    lo, hi = lo.copy(), hi.copy()
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        right = values[mid] <= x[todo] if after else values[mid] < x[todo]
        lo[todo[right]] = mid[right] + 1
        hi[todo[~right]] = mid[~right]
        todo = todo[lo[todo] < hi[todo]]
    return lo


def _bounds(points: DataFrame, total: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, times): at most parts - 1 places that cut the points into parts of about equal size, from some of them."""
    some = points.select("_h", "_t").sample(min(1.0, PER_PART * parts / max(1, total)), seed=1).collect()  # PER_PART rows a part
    rows = sorted((r[0], r[1]) for r in some)
    cuts = sorted({rows[k * len(rows) // parts] for k in range(1, parts)}) if rows else []
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def interval_join(intervals: DataFrame, instants: DataFrame, start: str, end: str, at: str, keys: list[str] | None = None) -> DataFrame:
    """All pairs of an interval (start to end, both included) and an instant in it, with equal keys; columns of both sides.

    start, end and at are whole numbers. The instants, ordered by a hash of the keys and by time, are cut into parts of about equal size (a sample finds
    the cuts, which decide nothing but the balance). An instant is sent to its part, an interval to the parts that it reaches into: in all but the first and last
    of them it holds every instant. So what is shuffled grows with the rows, and at most with the pairs, for intervals of any width and hot keys as well. A task holds
    the instants of one part, sorted, and streams its intervals past them: those in an interval are neighbours, and no other pair is formed. Intervals
    that end before they start, and nulls in keys, bounds or instants, match nothing. Instants equal in keys and time are in one part. Column
    names must differ but for the keys, which are taken from the intervals.
    """
    keys = keys or []
    spark = intervals.sparkSession
    there = [F.col(k).isNotNull() for k in keys]
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    long = lambda c: F.col(c).cast("long")
    hashed = (F.xxhash64(*keys) if keys else F.lit(0).cast("long")).alias("_h")
    points, spans = instants.where(F.col(at).isNotNull()), intervals.where(F.col(start) <= F.col(end))
    for c in there:
        points, spans = points.where(c), spans.where(c)
    points = points.select(hashed, long(at).alias("_t"), whole(instants).alias("_p"))
    spans = spans.select(hashed, long(start).alias("_t"), long(end).alias("_e"), whole(intervals).alias("_i"))
    total = points.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    hashes, times = _bounds(points, total, parts)

    @F.pandas_udf("int")
    def part(h: pd.Series, t: pd.Series) -> pd.Series:
        h, t = h.to_numpy(np.int64), t.to_numpy(np.int64)
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
        return pd.Series(_place(times, lo, hi, t, True).astype(np.int32))

    reach = F.sequence(part("_h", "_t"), part("_h", "_e"))
    p = points.select(part("_h", "_t").alias("_part"), F.lit(0).alias("_kind"), "_h", "_t", F.lit(None).cast("long").alias("_e"), "_p", F.lit(None).cast(spans.schema["_i"].dataType).alias("_i"))
    i = spans.select(F.explode(reach).alias("_part"), F.lit(1).alias("_kind"), "_h", "_t", "_e", F.lit(None).cast(points.schema["_p"].dataType).alias("_p"), "_i")
    by_part = p.unionByName(i).repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_kind", F.when(F.col("_kind") == 0, F.col("_h")), F.when(F.col("_kind") == 0, F.col("_t")))
    numbers = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        h = t = own = None
        for b in batches:
            if not b.num_rows:
                continue
            of, kind = numbers(b, "_part"), numbers(b, "_kind")
            begins = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1])))
            for a, z in zip(begins, np.append(begins[1:], b.num_rows), strict=True):
                s = b.slice(a, z - a)
                if of[a] != current:
                    current, held, h = of[a], [], None
                if not kind[a]:
                    held.append(s.select(["_h", "_t", "_p"]))
                    continue
                if not held:
                    continue
                if h is None:
                    h, t = (np.concatenate([numbers(x, c) for x in held]) for c in ("_h", "_t"))
                    own = pa.concat_arrays([x.column("_p") for x in held])
                key = numbers(s, "_h")
                lo, hi = np.searchsorted(h, key), np.searchsorted(h, key, "right")
                first, last = _place(t, lo, hi, numbers(s, "_t"), False), _place(t, lo, hi, numbers(s, "_e").astype(np.int64), True)
                upto = np.cumsum(last - first)
                for k in range(0, int(upto[-1]), PAIRS):
                    pair = np.arange(k, min(k + PAIRS, int(upto[-1])))
                    which = np.searchsorted(upto, pair, "right")
                    point = last[which] - (upto[which] - pair)
                    yield pa.RecordBatch.from_arrays([s.column("_i").take(pa.array(which)), own.take(pa.array(point))], names=["_i", "_p"])

    pairs = by_part.select("_part", "_kind", "_h", "_t", "_e", "_p", "_i").mapInArrow(sweep, by_part.select("_i", "_p").schema)
    for k in keys:
        # equal hashes may belong to different keys
        pairs = pairs.where(F.col(f"_i.`{k}`") == F.col(f"_p.`{k}`"))
    return pairs.select(*[F.col(f"_i.`{c}`").alias(c) for c in intervals.columns], *[F.col(f"_p.`{c}`").alias(c) for c in instants.columns if c not in keys])
