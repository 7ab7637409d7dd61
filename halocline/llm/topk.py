"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied, written

K = 5
SCALE = 256
GROUPS = 4
CANDIDATE_ROWS = 2048
QUERY_ROWS = 1024
#: Blocks of queries that a task holds beside its candidates, on average: 64 MB of 64 components each.
HELD_BLOCKS = 128
_BLOCK = "block long, ids array<long>, dims int, cells array<long>, energy array<double>"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; rows with null or non-finite parts, or no id, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), whole.alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` rows as flat arrays, packed where the rows are read, with each dimension's sum of squares.

    Shorter vectors are filled up with zeros. An Arrow batch gives one block or several, so blocks may be smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, size):
                piece = b.slice(at, size)
                vectors = piece.column(1).to_pylist()
                dims = max(map(len, vectors))
                cells = np.zeros((len(vectors), dims), np.int64)
                for k, v in enumerate(vectors):
                    cells[k, : len(v)] = v
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([dims], pa.int32()), pa.array([cells.ravel()], pa.list_(pa.int64())), pa.array([(cells.astype(np.float64) ** 2).sum(axis=0)], pa.list_(pa.float64()))], names=["block", "ids", "dims", "cells", "energy"])
                n += 1

    return written(rows.mapInArrow(tidied(run), _BLOCK), "vector-blocks")


def _matrix(cells: np.ndarray, rows: int, dims: int, width: int) -> np.ndarray:
    """The block's rows, filled up with zeros to the width."""
    return np.pad(cells.reshape(rows, dims), ((0, 0), (0, width - dims)))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products. Floats are exact below 2^53; larger ones are added up as integers."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of one row; ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        cols = np.flatnonzero(scores >= kth)
    else:
        cols = np.arange(len(scores))
    return cols[np.lexsort((ids[cols], -scores[cols]))[:k]]


def _lists(candidates: DataFrame, groups: int) -> tuple[list[np.ndarray], int]:
    """(the dimensions dealt to `groups` lists, those with the largest sums of squares first; the number of dimensions)."""
    found = candidates.select(F.posexplode("energy").alias("d", "e")).groupBy("d").agg(F.sum("e").alias("e")).collect()  # one row per dimension
    energy = np.zeros(len(found))
    for r in found:
        energy[r.d] = r.e
    return np.array_split(np.argsort(-energy, kind="stable"), groups), len(energy)


def _pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of candidates beside every block of queries: a stated query set against all rows, in blocks.

    Blocks are dealt to a grid with a cell per shuffle partition. Candidates are copied once per column of the grid, queries once
    per row, and the grid is as many times longer than wide as there are more candidates: both sides move about as much. It is wider where
    a column would have more than HELD_BLOCKS blocks of queries, which a task holds at once.
    """
    cells = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = max(1, queries.count()), max(1, candidates.count())
    wide = max(min(cells, max(1, round((cells * n / m) ** 0.5))), -(-n // HELD_BLOCKS))
    tall = max(1, -(-cells // wide))
    line = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = queries.select(F.col("block").alias("qb"), F.pmod(F.xxhash64("block"), F.lit(wide)).cast("int").alias("col"), line(tall).alias("row"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "block"])
    c = candidates.select("*", F.pmod(F.xxhash64("block"), F.lit(tall)).cast("int").alias("row"), line(wide).alias("col"))
    return c.join(q.hint("shuffle_hash"), ["row", "col"])


def _blocks(b: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """(query block, query ids, query matrix, candidate ids, candidate matrix, cutoffs) of each pair."""
    at = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
    for r in range(b.num_rows):
        c, q = (_matrix(at[n][r].values.to_numpy(), len(at[i][r]), at[d][r].as_py(), width) for n, i, d in (("cells", "ids", "dims"), ("q_cells", "q_ids", "q_dims")))
        cut = at["q_cutoffs"][r].values.to_numpy() if "q_cutoffs" in at else None
        yield at["qb"][r].as_py(), at["q_ids"][r].values.to_numpy(), q, at["ids"][r].values.to_numpy(), c, cut


def local_bounds(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, ids: np.ndarray, lists: list[np.ndarray], k: int) -> list[int | None]:
    """A score that k of the block's rows reach at least, for each query: the exact sums of the k best of the first list."""
    part = _scores(q[:, lists[0]], c[:, lists[0]])
    out: list[int | None] = []
    for r, query in enumerate(q_ids):
        others = np.flatnonzero(ids != query)
        top = others[_best(part[r, others], ids[others], k)]
        out.append(int(_scores(q[r : r + 1], c[top]).min()) if len(top) >= k else None)
    return out


def _norms(q: np.ndarray, c: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Upper bounds of the parts in these dimensions; a hair wider than the rounded norms."""
    left, right = (np.linalg.norm(x[:, dims].astype(np.float64), axis=1) for x in (q, c))
    return np.outer(left, right) * (1 + 1e-9) + 1e-6


def sufficient(q: np.ndarray, c: np.ndarray, cut: np.ndarray, lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each query: (rows of c that may reach its cutoff, their exact scores, products formed on the way).

    An entry suffices in a list if its part is at least cutoff / len(lists); a row that suffices nowhere stays below the cutoff.
    Norms bound a part and all parts to come, so parts are formed only where they may suffice and the row can still reach
    the cutoff. A part not formed is bounded by its norms and by what just does not suffice. Rows whose bounds add up to the cutoff
    are resolved exactly.
    """
    least = -(-cut // len(lists))[:, None]
    total = np.zeros((len(q), len(c)), np.int64)  # of the parts formed
    other = np.zeros((len(q), len(c)))  # bounds of the others
    enough = np.zeros((len(q), len(c)), bool)
    whole = np.ones(len(c), bool)
    products = 0
    for k, g in enumerate(lists):
        bound = _norms(q, c, g)
        alive = total + other + _norms(q, c, np.concatenate(lists[k:])) >= cut[:, None]
        formed = ((bound >= least) & alive).any(axis=0)
        cols, left = np.flatnonzero(formed), np.flatnonzero(~formed)
        if len(cols):
            part = _scores(q[:, g], c[cols][:, g])
            total[:, cols] += part
            enough[:, cols] |= part >= least
            products += len(cols) * len(g)
        other[:, left] += np.where(alive[:, left], np.minimum(bound[:, left], np.maximum(least - 1.0, -bound[:, left])), -np.inf)
        whole &= formed
    for r in range(len(q)):
        rows = np.flatnonzero(enough[r] & (total[r] + other[r] >= cut[r] - 1e-9 * abs(cut[r]) - 1))
        score, rest = total[r, rows], np.flatnonzero(~whole[rows])
        score[rest] = _scores(q[r : r + 1], c[rows[rest]])[0]
        yield rows, score, products + len(rest) * q.shape[1]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, groups: int = GROUPS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query selects, the k highest inner products with all other rows.

    The dimensions fall into `groups` lists; a pair's score is the sum of its parts in them.
    1. Every block of rows gathers its k best entries of the first list for each query. Their exact scores give a bound that k
       rows reach at least: the largest such bound over all blocks is a safe cutoff.
    2. With the cutoffs, every block collects the entries that suffice: those with a part of at least cutoff / groups in some list.
    3. The remaining parts of those that can still reach the cutoff are resolved; those below it go, and the k best are merged.

    How much the cutoffs save depends on the vectors: parts are skipped where norms are too small, so much is saved where
    few dimensions or few rows carry the scores, and next to nothing where all are alike.

    Components are floor(scale * x). Rows that are null, or hold null, NaN or infinite parts, or have no id take no part. Ties go
    to the smaller vec_id. Shorter vectors count as filled up with zeros. A query's own rows are those with its id; a repeated query
    id asks once (the smallest of its vectors), repeated candidate rows take a place each. Fewer than k others: all
    of them. An empty table gives no rows. Scores must fit in 64 bits. Other columns are not read, whatever their names.
    """
    rows = integer_vectors(vectors.select("vec_id", "embedding"), scale)
    asked = integer_vectors(vectors.where(is_query).select("vec_id", "embedding"), scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates, queries = _packed(rows, CANDIDATE_ROWS), _packed(asked, QUERY_ROWS)
    lists, width = _lists(candidates, groups)
    candidates, queries = candidates.drop("energy"), queries.drop("energy")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qb, q_ids, q, ids, c, _ in _blocks(b, width):
                bounds = local_bounds(q, q_ids, c, ids, lists, k)
                yield pa.RecordBatch.from_arrays([pa.array([qb] * len(q_ids), pa.int64()), pa.array(q_ids), pa.array(bounds, pa.int64())], names=["qb", "query_id", "cutoff"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, q_ids, q, ids, c, cuts in _blocks(b, width):
                out: list[list] = [[], [], []]
                for query, cut, (found, score, _) in zip(q_ids, cuts, sufficient(q, c, cuts, lists), strict=True):
                    keep = (score >= cut) & (ids[found] != query)
                    found, score = found[keep], score[keep]
                    top = _best(score, ids[found], k)
                    out[0] += [int(query)] * len(top)
                    out[1] += ids[found[top]].tolist()
                    out[2] += score[top].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    bounds = _pairs(queries, candidates).mapInArrow(tidied(gather), "qb long, query_id long, cutoff long")
    lowest = F.lit(-(1 << 62)).cast("long")
    cutoffs = bounds.groupBy("qb", "query_id").agg(F.coalesce(F.max("cutoff"), lowest).alias("cutoff"))
    by_block = cutoffs.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "cutoff"))).alias("cut"))  # QUERY_ROWS entries at most
    by_block = written(by_block, "cutoffs")
    ready = queries.join(by_block, queries.block == by_block.qb).select("block", "ids", "dims", "cells", F.transform("ids", lambda i: F.element_at("cut", i)).alias("cutoffs"))
    found = _pairs(ready, candidates).mapInArrow(tidied(collect), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
