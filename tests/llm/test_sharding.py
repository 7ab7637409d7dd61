import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from halocline.llm.queries import op11_reshard
from halocline.llm.sharding import ShardStore, equal_capacities, min_cost_flow, reshard_documents, resharded, transfers, with_sizes

from .helpers import EXTRA, docs


def cheapest(sizes, capacities, cost):
    """Least cost of all ways to deal out the sizes, unit by unit."""
    best = None
    units = [s for s, n in sizes.items() for _ in range(n)]
    for ways in itertools.product(capacities, repeat=len(units)):
        if all(ways.count(t) <= c for t, c in capacities.items()):
            total = sum(cost(s, t) for s, t in zip(units, ways, strict=True))
            best = total if best is None else min(best, total)
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(5)
    for _ in range(40):
        sizes = {s: rng.randrange(3) for s in range(3)}
        capacities = {t: rng.randrange(1, 4) for t in range(1, 4)}
        if sum(sizes.values()) > sum(capacities.values()):
            with pytest.raises(ValueError):
                transfers(sizes, capacities)
            continue
        prices = {(s, t): rng.randrange(6) for s in sizes for t in capacities}
        for cost in (None, lambda s, t, prices=prices: prices[s, t]):
            moves = transfers(sizes, capacities, cost)
            price = cost or (lambda s, t: int(s != t))
            assert sum(n * price(s, t) for s, t, n in moves) == cheapest(sizes, capacities, price)
            for s, n in sizes.items():
                assert sum(m for a, _, m in moves if a == s) == n
            for t, c in capacities.items():
                assert sum(m for _, b, m in moves if b == t) <= c


def test_flow_may_have_to_go_back():
    # the cheapest first path must be undone by the second
    arcs = [(0, 2, 1, 1), (0, 3, 1, 2), (2, 3, 1, 0), (2, 4, 1, 5), (3, 4, 1, 1), (4, 1, 2, 0), (3, 1, 0, 0)]
    flow = min_cost_flow(arcs, 0, 1)
    assert flow[5] == 2 and sum(f * a[3] for f, a in zip(flow, arcs, strict=True)) == 9


def test_fewest_bytes_of_many_shards():
    rng = random.Random(2)
    sizes = {s: rng.randrange(10**9) for s in range(60)}
    capacities = equal_capacities(sum(sizes.values()), 90)
    moves = transfers(sizes, capacities)
    assert sum(n for s, t, n in moves if s != t) == sum(max(0, n - capacities[s]) for s, n in sizes.items())
    assert len(moves) <= 60 + 90 + 60


def some_docs(spark, n=400):
    rng = random.Random(9)
    rows = [(k, "é" * rng.randrange(60) if k % 3 else "w" * 500, rng.choice("aaaab")) for k in range(n)]
    return docs(spark, [*rows, (3, "w" * 500, "a"), (3, "w" * 500, "a"), (None, None, None), (None, "", "b"), (n, "same", "a"), (n + 1, "same", "a")], EXTRA)


def old_shard():
    return F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 5)


def test_rows_stay_whole_and_sizes_are_near(spark):
    d = some_docs(spark)
    rows, moves = resharded(d, F.coalesce(old_shard(), F.lit(0)), 6)
    assert [c for c in rows.columns if c not in ("old_shard", "size", "text_crc32", "_key", "shard")] == [c for c in d.columns if c != "size"]
    got = rows.collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source, r.n_chars) for r in got))) == sorted(map(str, ((r.doc_id, r.text, r.source, r.n_chars) for r in d.collect())))
    sizes = {}
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) < 508
    # no more moves than the flow asks for, but for a row at each cut
    moved = sum(r["size"] for r in got if r.shard != r.old_shard)
    assert abs(moved - sum(n for s, t, n in moves if s != t)) <= 2 * 508 * len(moves)


def test_slots_have_no_gaps(spark):
    out = reshard_documents(some_docs(spark), old_shard(), 6).collect()
    assert len(out) == 406
    for k in range(6):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    again = reshard_documents(some_docs(spark).repartition(7), old_shard(), 6).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert reshard_documents(docs(spark, [], EXTRA), old_shard()).count() == 0
    assert {(r.doc_id, r["size"], r.slot) for r in reshard_documents(docs(spark, [None, ""]), old_shard(), 1).collect()} == {(0, 8, 0), (1, 8, 1)}


def test_only_files_of_shards_that_change_are_written(spark, tmp_path):
    d = docs(spark, [(k, "x" * 92, "a") for k in range(90)])
    # shards 0 to 2 of 30, 30 and 30 rows; a fourth takes of all, then two of the four give up theirs
    store = ShardStore.create(with_sizes(d, F.col("doc_id") % 3).withColumn("shard", F.col("old_shard")), f"{tmp_path}/store")
    same = store.reshard(3)
    assert same is store
    uneven = ShardStore.create(with_sizes(d, F.when(F.col("doc_id") < 30, 0).when(F.col("doc_id") < 75, 1).otherwise(2)).withColumn("shard", F.col("old_shard")), f"{tmp_path}/uneven")
    even = uneven.reshard(3)
    before, after = uneven.folders(), even.folders()
    assert before[0] == after[0] and before[1] != after[1] and before[2] != after[2]
    sizes = {r.shard: r["count"] for r in even.read().groupBy("shard").count().collect()}
    assert sizes == {0: 30, 1: 30, 2: 30} and uneven.read([1]).count() == 45
    assert {r.doc_id for r in even.read([1, 2]).collect()} == set(range(30, 90))
    grown = even.reshard(5)
    assert {r.shard: r["count"] for r in grown.read().groupBy("shard").count().collect()} == dict.fromkeys(range(5), 18)
    less = grown.reshard(2)
    assert {r.shard: r["count"] for r in less.read().groupBy("shard").count().collect()} == {0: 45, 1: 45}
    assert grown.read().where("old_shard <> shard").count() == 36


def test_query_over_documents(spark, sf):
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_reshard(spark, sf).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in rows.items()}
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(24)]
    # some eight rows a shard; the smallest even them out
    assert max(sizes) - min(sizes) <= 0.1 * sum(sizes) / 24 and {r.law for r in got} == {"bytes"}
