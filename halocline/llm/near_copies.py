"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, for the pipeline's near-dedup.

The SimHash operator's ball of radius 2 proposes the closest pairs. By the angle estimate, copies of similarity 0.8 differ in about
ten of 64 bits, and a ball that wide can't be enumerated; so bands of min-hashes propose the others. Every pair is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT_WORDS, WordHashes, connected_components, key_bits, maybe_among, only_rows, rolling, row_key, short_batches, tidied, written
from .simhash import near_links

SHINGLE = 5
#: Similarity 0.8 as a ratio of integers, so that the comparison is exact.
SIMILARITY = (4, 5)
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9994 at 0.8.
BANDS, ROWS = 40, 8
SEED = 42
#: Members of a bucket that are compared pair by pair; in larger ones the leader is compared with all.
PAIRED = 4
#: Bands after a band that its large mixed buckets are divided by, one at a time.
NEXT = 3

_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of `size` words; a shorter text is one shingle, a text without words has none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(rolling(h, min(size, len(h))))


def bands(grams: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of min-hashes."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        np.minimum(low, (short[k : k + 1024, None] * _MULTIPLIERS).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def simhash_of(grams: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes: a bit is set if over half of them have it."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(grams), 65536):
        count += np.unpackbits(grams[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(grams), bitorder="little").view(np.uint64)[0])


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, node, n, fp, bands): node identifies the lower-cased (A-Z) words of a text, n counts its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(SEED, KEPT_WORDS)
        for b in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for text in b.column(2).to_pylist():
                words = (text or b"").lower().split()
                grams = shingles(words, hashes, size)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                sizes.append(len(grams))
                fps.append(simhash_of(grams))
                keys.append(bands(grams).view(np.int64) if len(grams) else [])
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, pa.array(sizes, pa.int64()), fp, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "n", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), F.col("text").cast("binary"))
    return rows.mapInArrow(tidied(run), "doc_id long, row long, node long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, of: DataFrame, size: int) -> DataFrame:
    """(node, grams) of the nodes' representative rows in of (row, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(SEED, KEPT_WORDS)
        for b in batches:
            grams = [shingles((t or b"").lower().split(), hashes, size).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    rows = docs.select("text", row_key("doc_id", "text").alias("row"))
    may, _ = maybe_among(rows, F.col("row"), key_bits(of, "row"))
    picked = may.join(of.withColumnRenamed("row", "_key").hint("shuffle_hash"), "_key").select("node", F.col("_own.text").cast("binary").alias("text"))
    return picked.mapInArrow(tidied(run), "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) whose sets reach the similarity."""
    p, q = SIMILARITY
    # of the sets, only those of this round's pairs are shuffled
    left, right = (only_rows(sets, F.col("node"), written(pairs.select(c).distinct(), "pair-ends"), c) for c in ("a", "b"))
    left, right = left.select(F.col("node").alias("a"), F.col("grams").alias("x")), right.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both * (p + q) >= p * (F.size("x") + F.size("y"))).select("a", "b")


def _alike(a: str, b: str) -> Column:
    """Sizes that allow the similarity."""
    p, q = SIMILARITY
    return F.least(a, b) * q >= F.greatest(a, b) * p


def _ball_pairs(texts: DataFrame) -> DataFrame:
    """(a, b) from the SimHash ball: texts to the first one of their fingerprint, and first ones whose fingerprints are linked."""
    with_words = texts.where("n > 0")
    first = written(with_words.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("m")), "fp-firsts")
    within = with_words.join(first.where("m > 1"), "fp").where("node != first.node").select("first.node", "first.n", F.col("node").alias("b"), F.col("n").alias("nb")).toDF("a", "na", "b", "nb")
    one = lambda side: first.select(F.col("fp").alias(side), F.col("first.node").alias(f"node_{side}"), F.col("first.n").alias(f"n{side}"))
    between = near_links(first.select("fp")).join(one("a"), "a").join(one("b"), "b").select(F.col("node_a").alias("a"), "na", F.col("node_b").alias("b"), "nb")
    return within.unionByName(between).where(_alike("na", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bucket_pairs(members: DataFrame, components: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """members (key, node, n, last) -> (candidate pairs (a, b), members of the large buckets that are not in one component).

    In a small bucket all pairs of different components are candidates, in a large one the pairs of its leader, chosen by hash.
    """
    if components is None:
        now = members.withColumn("component", F.col("node"))
    else:
        now = written(members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "band-rows")
    lead = now.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("node", "key"), "node", "n", "component")).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"))
    lead = written(lead.where("low < high").select("key", "m", "lead"), "band-leaders")
    small = now.join(lead.where(F.col("m") <= PAIRED).select("key"), "key", "left_semi")
    a = small.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    b = small.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = a.join(b, "key").where("a < b and ca != cb")
    large = now.join(lead.where(F.col("m") > PAIRED), "key")
    led = large.where("component != lead.component").select(F.col("lead.node").alias("a"), F.col("lead.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    found = pairs.select("a", "na", "b", "nb").unionByName(led).where(_alike("na", "nb")).select("a", "b").distinct()
    return written(found, "candidate-pairs"), large.select("key", "node", "n", "last")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key several have."""
    keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "shared-bands")
    return written(only_rows(rows, F.col("key"), keys, "key"), "band-members")


def _prefix_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """left (node, n, component) -> (a, b): all pairs of different components that may reach the similarity.

    A prefix filter: with shingles in one order, the rarest first, two such texts share one of their first n - ceil(n * similarity) + 1. Pairs that share
    one must be of sizes that allow the similarity, and have enough shingles left behind it.
    """
    p, q = SIMILARITY
    nodes = written(left.select("node"), "prefix-nodes")
    each = only_rows(sets, F.col("node"), nodes, "node").select("node", F.explode("grams").alias("gram"))
    each = written(each, "prefix-grams")
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
    # a shingle that one text has links nothing, but stands first in its order
    # sorted within a text by a window, which can spill
    at = F.row_number().over(Window.partitionBy("node").orderBy("m", "gram")) - 1
    length = F.col("n") - F.ceil(F.col("n") * p / q) + 1
    ordered = each.join(counts, "gram").select("node", "gram", "m", at.alias("at")).join(left, "node")
    rows = written(ordered.where((F.col("at") < length) & (F.col("m") > 1)).select("gram", "node", "n", "component", "at"), "prefixes")
    a, b = (rows.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "component", "at")]) for side in "ab")
    behind = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & _alike("n_a", "n_b") & (behind * (p + q) >= p * (F.col("n_a") + F.col("n_b")))
    return written(a.join(b, "gram").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "prefix-pairs")


def near_copies(docs: DataFrame, size: int = SHINGLE, exact: bool = False) -> DataFrame:
    """(doc_id, row, component): one row per row of docs (doc_id, text); row is row_key(doc_id, text).

    Texts of the same words (A-Z lower-cased, white space aside) are copies; so are all texts without words. Other texts link if
    their shingles have a Jaccard similarity of SIMILARITY or more and they are proposed as a pair; components are transitive.
    Proposed are texts within the SimHash ball, and texts that share a band of min-hashes: all pairs of a small bucket, the
    leader of a large one with all its members. That settles a group of near copies, however large. A large bucket that is
    then still in several components holds texts that are somewhat alike; its members are divided by each of the NEXT bands that
    follow, and each part proposes pairs in the same way. So the proposals of a text are bounded however large its group is:
    at most BANDS * (1 + NEXT) leaders and as many small buckets. Two texts are not proposed to each other if all the
    buckets they share are large, lead by others, and in several components; most such pairs are linked through a leader.

    exact: no such pair is left out. Members of large buckets that are in several components to the end are joined by the rarest of their
    shingles, which finds every pair that reaches the similarity; how many pairs are looked at then depends on how many texts
    are alike a bit below it.
    """
    spark = docs.sparkSession
    short_batches(spark)
    signed = written(_signed(docs, size), "signed")
    texts = written(signed.groupBy("node", "n", "fp", "bands").agg(F.min("row").alias("row")), "signed-texts")
    each = texts.select("node", "n", F.posexplode("bands").alias("last", "band")).withColumn("key", F.xxhash64("last", "band")).drop("band")
    members = _shared(each)
    pairs, large = _bucket_pairs(members, None)
    large = written(large, "large-buckets")
    pairs = written(_ball_pairs(texts).unionByName(pairs).distinct(), "first-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    chosen = written(texts.join(ends, "node", "left_semi").select("row", "node"), "candidates")
    sets = written(_sets(docs, chosen, size), "shingle-sets")
    links = written(_verified(pairs, sets), "near-links")
    components = written(connected_components(links), "near-components")
    # what is left: large buckets in several components
    placed = large.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = only_rows(large, F.col("key"), written(mixed, "mixed-bands"), "key").join(texts.select("node", "bands"), "node")
    at = F.transform(F.sequence(F.lit(1), F.lit(NEXT)), lambda k: F.pmod(F.col("last") + k, F.lit(BANDS)))
    finer = left.select("key", "node", "n", "bands", F.explode(at).alias("at"))
    finer = finer.select(F.xxhash64("key", "at", F.get("bands", F.col("at"))).alias("key"), "node", "n", F.col("at").alias("last"))
    finer = written(finer, "finer-rows")
    pairs, _ = _bucket_pairs(_shared(finer), components)
    links = links.unionByName(written(_verified(pairs, sets), "near-links"))
    components = written(connected_components(links), "near-components")
    if exact:
        now = large.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        rest = written(only_rows(now, F.col("key"), written(open_, "open-bands"), "key").select("node", "n", "component").distinct(), "open-texts")
        links = written(links.unionByName(_verified(_prefix_pairs(rest, sets), sets)), "near-links")
        components = written(connected_components(links), "near-components")
    return signed.join(components, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))
