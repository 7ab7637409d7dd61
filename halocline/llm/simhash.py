"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, short_batches, tidied, written

SHINGLE = 3
SEED = 42
RADIUS = 2


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles; a bit is set if over half of the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    h = np.array([digest(joined[s:e], seed) for s, e in pairs], np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        count += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): every row of docs, whole texts; null texts have no words."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tidied(run), "doc_id long, fp long")


def variants(fp: str, radius: int):
    """All values within `radius` bits of a fingerprint, as an array column."""
    ball = F.array(F.col(fp))
    for _ in range(radius):
        # each step flips one more bit or none
        ball = F.array_distinct(F.flatten(F.transform(ball, lambda v: F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, v).otherwise(v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))))
    return ball


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps (fp, one row each) -> (a, b): links that connect all fingerprints within radius bits of each other.

    Every fingerprint emits the variants within half the radius; two fingerprints within the radius share one. A
    variant's bucket holds at most the ball around it, so it is bounded. Its members link to its smallest member;
    for an even radius members are within the radius of each other, and each link is verified all the same. For an
    odd radius one of the two halves is larger, and links within a bucket are verified pairwise.
    """
    half = (radius + 1) // 2
    emitted = fps.select("fp", F.explode(variants("fp", half)).alias("v"))
    if radius % 2 == 0:
        pairs = emitted.select("fp", F.min("fp").over(Window.partitionBy("v")).alias("b"))
    else:
        pairs = emitted.groupBy("v").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("fp"), "all").select("fp", F.explode("all").alias("b"))
    linked = pairs.where((F.col("b") < F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius))
    return linked.select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints within `radius` bits link; component_id is the smallest id reachable.

    Copies share a fingerprint and are handled as one. Texts without words have fingerprint 0 and link like any
    other; long texts are fingerprinted whole, eight bytes a shingle. Null ids are never the smallest id (null only if a component has no other). Repeated rows give repeated
    rows; an empty table gives an empty one; other columns are not read.
    """
    fps = written(with_fingerprints(docs, shingle, seed), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-classes")
    components = written(connected_components(near_links(classes.select("fp"), radius)), "fp-components")
    placed = classes.join(components, classes.fp == components.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = written(placed.join(smallest, "component").select("fp", "component_id"), "fp-labels")
    return fps.join(labelled, "fp").select("doc_id", "fp", "component_id")
