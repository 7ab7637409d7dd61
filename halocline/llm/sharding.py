"""Resharding by minimum-cost flow: which bytes of which shard go where, and the files that this rewrites."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import new_path, prefix_sums, written

SHARDS = 24
#: Bytes that a row takes beside its text.
ROW_BYTES = 8
#: Further rounds mend, with the smallest rows, what whole rows at the cuts of the first have left uneven.
ROUNDS = 3
_OWN = ("size", "text_crc32", "old_shard", "shard")


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost >= 0) of a cheapest maximum flow.

    Successive shortest paths; potentials keep the costs of arcs back from being negative. Nodes are shards, so there are few.
    """
    out: dict[int, list[int]] = {}
    ends, left, cost = [], [], []
    for a, b, capacity, c in arcs:
        for x, y, room, price in ((a, b, capacity, c), (b, a, 0, -c)):
            out.setdefault(x, []).append(len(ends))
            ends.append(y)
            left.append(room)
            cost.append(price)
    potential = dict.fromkeys(out, 0)
    while True:
        far, by, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out.get(x, ()):
                y, through = ends[e], d + cost[e] + potential[x] - potential[ends[e]]
                if left[e] and through < far.get(y, through + 1):
                    far[y], by[y] = through, e
                    heapq.heappush(heap, (through, y))
        if sink not in by:
            return [left[2 * k + 1] for k in range(len(arcs))]
        most = max(far.values())
        for x in potential:
            potential[x] += far.get(x, most)
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = ends[by[x] ^ 1]
        room = min(left[e] for e in path)
        for e in path:
            left[e] -= room
            left[e ^ 1] += room


def transfers(sizes: dict[int, int], capacities: dict[int, int], cost: Callable[[int, int], int] | None = None) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) that brings shards of the given sizes within their capacities by moving the fewest bytes.

    What stays comes first of its shard. A byte costs nothing where it stays and 1 elsewhere, which needs one node that all moves go
    through; cost(old, new) gives other prices, and an arc a pair. ValueError if the capacities do not suffice.
    """
    if sum(sizes.values()) > sum(capacities.values()):
        raise ValueError("more bytes than the shards may hold")
    source, sink, hub = 0, 1, 2
    old = {s: 3 + k for k, s in enumerate(sorted(sizes))}
    new = {s: 3 + len(old) + k for k, s in enumerate(sorted(capacities))}
    ends = [(source, n, sizes[s], 0) for s, n in old.items()] + [(n, sink, capacities[s], 0) for s, n in new.items()]
    if cost is None:
        pairs = [(s, s) for s in old if s in new]
        inner = [(old[s], new[s], sizes[s], 0) for s, _ in pairs] + [(n, hub, sizes[s], 1) for s, n in old.items()] + [(hub, n, capacities[s], 0) for s, n in new.items()]
    else:
        pairs = [(s, t) for s in old for t in new]
        inner = [(old[s], new[t], sizes[s], cost(s, t)) for s, t in pairs]
    flow = min_cost_flow(ends + inner, source, sink)[len(ends) :]
    found = [(s, t, n) for (s, t), n in zip(pairs, flow, strict=False) if n]
    if cost is None:
        give = [[s, n] for s, n in zip(old, flow[len(pairs) :], strict=False) if n]
        for t, n in zip(new, flow[len(pairs) + len(old) :], strict=True):
            while n:
                moved = min(n, give[-1][1])
                found.append((give[-1][0], t, moved))
                give[-1][1] -= moved
                n -= moved
                if not give[-1][1]:
                    give.pop()
    return sorted(found, key=lambda x: (x[0], x[0] != x[1], x[1]))


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {k: total // shards + (k < total % shards) for k in range(shards)}


def with_sizes(docs: DataFrame, old: Column) -> DataFrame:
    """docs plus old_shard, size, text_crc32 and _key, a hash of id and text that orders the rows of a shard at random."""
    text = F.coalesce("text", F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*_OWN, "_key")]
    return docs.select(*own, old.cast("int").alias("old_shard"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", text).alias("_key"))


def _order(turn: int) -> list[Column]:
    """The order of a shard's rows in a round: at random, then the largest first, so that the last to go are small."""
    order = [F.col("_key")] if turn == 0 else [-F.col("size"), F.col("_key")]
    return [c.alias(f"_o{k}") for k, c in enumerate(order)]


def _sums(rows: DataFrame, value: Column) -> dict[int, int]:
    """One number a shard."""
    return {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum(value)).collect()}


def _starts(totals: dict[int, int]) -> Column:
    """The sum of all shards before a row's shard."""
    ends, out = 0, {}
    for s in sorted(totals):
        out[s] = ends
        ends += totals[s]
    return F.element_at(F.from_json(F.lit("[" + ",".join(str(out.get(k, 0)) for k in range(max(out, default=0) + 1)) + "]"), "array<long>"), F.col("shard") + 1)


def cuts(rows: DataFrame, moves: Iterable[tuple[int, int, int]], turn: int) -> DataFrame:
    """rows (shard, size, _key) -> (shard, ends, targets): where each shard's rows are cut in the round's order, a row per shard.

    A shard's moves are intervals of its bytes; a row goes where its middle lies, and an interval ends with its last row. Prefix sums
    over narrow rows find the ends, so rows that know their shard, size and key need meet nothing but this small table.
    """
    bounds: dict[int, list[tuple[int, int]]] = {}
    for s, t, n in moves:
        own = bounds.setdefault(s, [])
        own.append((t, (own[-1][1] if own else 0) + n))
    named = [f"_o{k}" for k in range(len(_order(turn)))]
    keyed = rows.select("shard", "size", *_order(turn))
    summed = prefix_sums(keyed, ["shard", *named], ["size"])
    middle = F.col("before_size") - _starts(_sums(rows, F.col("size"))) + F.col("size") / 2
    spark = rows.sparkSession
    table = spark.createDataFrame([(s, [float(e) for _, e in own[:-1]], [t for t, _ in own]) for s, own in bounds.items()], "shard int, bounds array<double>, targets array<int>")
    part = F.size(F.filter("bounds", lambda b: b <= F.col("middle")))
    placed = summed.select("shard", middle.alias("middle"), F.struct(*named).alias("at")).join(F.broadcast(table), "shard")  # a row per shard
    last = placed.groupBy("shard", part.alias("part")).agg(F.max("at").alias("end"))
    ends = last.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "end"))).alias("parts"))  # a row per move
    return written(ends.join(F.broadcast(table.select("shard", "targets")), "shard"), "shard-cuts")


def placed(rows: DataFrame, cut: DataFrame, turn: int) -> DataFrame:
    """rows (shard, size, _key, ...) with the shard that the cuts give them; no row is shuffled."""
    own = rows.columns
    at = F.struct(*_order(turn))
    first = F.get(F.filter("parts", lambda p: at <= p["end"]), F.lit(0))
    joined = rows.withColumn("_at", at).join(F.broadcast(cut.withColumnRenamed("shard", "_from")), F.col("shard") == F.col("_from"))  # a row per shard
    return joined.select(*[F.col(f"`{c}`") for c in own if c != "shard"], F.get("targets", first["part"]).alias("shard"))


def resharded(docs: DataFrame, old: Column, shards: int = SHARDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(docs plus old_shard, size, text_crc32, _key and shard; the moves between the old shards and the new).

    old: the shard from 0 that a row stands in. The new shards 0 to shards - 1 get capacities that differ by a byte at most; a flow of
    least cost says which bytes move, and rows follow whole. Texts are read, but neither shuffled nor joined: the plan is made from
    narrow rows, and each row finds its shard from its own size and key.
    """
    rows = with_sizes(docs, old).withColumn("shard", F.col("old_shard"))
    narrow = written(rows.select("shard", "size", "_key"), "shard-rows")
    first: list[tuple[int, int, int]] = []
    for turn in range(rounds):
        sizes = _sums(narrow, F.col("size"))
        moves = transfers(sizes, equal_capacities(sum(sizes.values()), shards))
        first = first or moves
        if all(s == t for s, t, _ in moves):
            break
        cut = cuts(narrow, moves, turn)
        rows, narrow = placed(rows, cut, turn), placed(narrow, cut, turn)
    return rows, first


class ShardStore:
    """Shards as Parquet files below a folder. A manifest, written anew by each change, tells in which folder a shard's files lie.

    Files are never overwritten, so a reader of an older manifest, or a task that is run again, finds what it expects.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, version: int = 0):
        self.spark, self.path, self.schema, self.version = spark, path, schema, version

    @classmethod
    def create(cls, rows: DataFrame, path: str | None = None) -> ShardStore:
        """rows with shard, as resharded or with_sizes give them."""
        spark = rows.sparkSession
        store = cls(spark, path or new_path(spark, "shards"), rows.schema)
        store._write(rows, spark.createDataFrame([], "shard int, folder string"))
        return store

    def _write(self, rows: DataFrame, kept: DataFrame) -> None:
        folder = f"{self.path}/files-{self.version}"
        # a large shard is written by several tasks, small ones share a task
        rows.withColumn("_part", F.col("shard")).hint("rebalance", "_part").write.partitionBy("_part").parquet(folder)
        new = self.spark.read.schema("_part int").parquet(folder).select(F.col("_part").alias("shard")).distinct().withColumn("folder", F.concat(F.lit(f"{folder}/_part="), F.col("shard")))
        kept.unionByName(new).coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")  # a row per shard

    def folders(self) -> dict[int, str]:
        """One per shard that has rows."""
        return {r.shard: r.folder for r in self.spark.read.parquet(f"{self.path}/manifest-{self.version}").collect()}

    def read(self, shards: Iterable[int] | None = None) -> DataFrame:
        found = self.folders()
        own = [f for s, f in sorted(found.items()) if shards is None or s in set(shards)]
        return self.spark.read.schema(self.schema).parquet(*own) if own else self.spark.createDataFrame([], self.schema)

    def reshard(self, shards: int, rounds: int = ROUNDS) -> ShardStore:
        """The store with another number of shards; only files of shards that give or take rows are written again."""
        narrow = self.read().select("shard", "size", "_key")
        sizes = _sums(narrow, F.col("size"))
        moves = transfers(sizes, equal_capacities(sum(sizes.values()), shards))
        touched = {x for s, t, _ in moves if s != t for x in (s, t)}
        if not touched:
            return self
        rows = self.read(touched)
        narrow, rows = rows.select("shard", "size", "_key"), rows.withColumn("old_shard", F.col("shard"))
        cap = equal_capacities(sum(sizes.values()), shards)
        for turn in range(rounds):
            own = _sums(narrow, F.col("size"))
            room = {t: cap[t] for t in touched if t in cap}
            # untouched shards are full to a byte; rounding may leave a byte too little room
            room[max(room)] += max(0, sum(own.values()) - sum(room.values()))
            moves = transfers(own, room)
            cut = cuts(narrow, moves, turn)
            rows, narrow = placed(rows, cut, turn), placed(narrow, cut, turn)
        after = ShardStore(self.spark, self.path, self.schema, self.version + 1)
        kept = [(s, f) for s, f in self.folders().items() if s not in touched]
        after._write(rows.select(*self.schema.names), self.spark.createDataFrame(kept, "shard int, folder string"))
        return after

    def slots(self) -> DataFrame:
        """(doc_id, size, text_crc32, old_shard, shard, slot): a row's place in its shard, from 0, by id (nulls last) and key."""
        narrow = self.read().select("doc_id", "size", "text_crc32", "old_shard", "shard", "_key", F.lit(1).cast("long").alias("one"))
        placed = prefix_sums(narrow, ["shard", "doc_id", "_key"], ["one"])
        return placed.withColumn("slot", F.col("before_one") - _starts(_sums(narrow, F.col("one")))).drop("one", "before_one", "_key")


def reshard_documents(docs: DataFrame, old: Column, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of docs moved from their old shards to `shards` shards of near-equal bytes.

    The rows, whole and with all their columns, are written as the files of a ShardStore, from which the result is read. A row takes
    the bytes of its text (null: none) and 8 more. A null text has the checksum of the empty one. A null shard counts as 0. Shards differ by about a
    row of the smallest sizes, unless single rows are larger than a shard's share. Rows equal in id and text stand at one place and stay
    together; all other ties are broken by a hash. A long text is one row and is not cut. An empty table gives no rows. Columns named
    size, text_crc32, old_shard, shard or _key are replaced, all others stay, whatever their names.
    """
    rows, _ = resharded(docs, F.coalesce(old, F.lit(0)), shards)
    return ShardStore.create(rows, path).slots()
