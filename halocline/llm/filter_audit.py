"""How filters of documents overlap: what each removes in every order, with duplicates found by partition refinement."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_bits, maybe_among, row_key, short_batches, tidied, words_of, written

#: The letters of the filters, in the order of their bits; E is the filter of repeated texts.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Bytes of a text's first block; each further block is BLOCK_GROWTH times as long as all before it, so a text of any length has few.
FIRST_BLOCK = 64
BLOCK_GROWTH = 7
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Limits:
    """When a text fails: A by few words, B by few distinct ones (in 100), C by many capitals (in 100 code points), D by any of the marks."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    marks: bytes = b"#$%&*|"

    def failed(self, text: bytes, n_chars: int) -> int:
        words = words_of(text)
        capitals = len(text) - len(text.translate(None, _CAPITALS))
        marked = len(text.translate(None, self.marks)) < len(text)
        return (len(words) < self.words) | (100 * len(set(words)) < self.distinct * len(words)) << 1 | (100 * capitals > self.capitals * n_chars) << 2 | marked << 3


def block_hashes(text: bytes) -> list[int]:
    """Hashes of successive blocks that cover the whole text."""
    out, end = [], 0
    while end < len(text):
        start, end = end, end * (BLOCK_GROWTH + 1) or FIRST_BLOCK
        out.append(xxhash.xxh64_intdigest(text[start:end]) - (1 << 63))
    return out


def judged_texts(docs: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """(doc_id, row, part, failed, n_chars, blocks): every row of docs with the bits of the filters A to D that its text fails.

    One scan of whole texts; null texts count as empty, null parts as the empty string. row is a hash of id and text.
    """
    short_batches(docs.sparkSession)
    names = ["doc_id", "row", "part", "failed", "n_chars", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(3).to_pylist()]
            chars = [len(t.translate(None, _CONTINUATION)) for t in texts]
            failed = [limits.failed(t, n) for t, n in zip(texts, chars, strict=True)]
            blocks = pa.array([block_hashes(t) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(failed, pa.int32()), pa.array(chars, pa.int64()), blocks], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("row"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary"))
    return rows.mapInArrow(tidied(run), "doc_id long, row long, part string, failed int, n_chars long, blocks array<long>")


def refined(rows: DataFrame) -> DataFrame:
    """rows (n_chars, blocks, ...) that share length and all block hashes with another row, as a written table.

    Classes are split by length, then by one block after another. A class is counted with map-side sums; rows alone in theirs
    are dropped before the next block, so that long texts' later blocks are looked at where all before them agree.
    """
    own = rows.columns
    left, n = rows.withColumn("_class", F.xxhash64("n_chars")), 0
    while True:
        classes = written(left.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_class"), "classes")
        left = written(left.join(classes, "_class", "left_semi"), "refined")
        if (left.agg(F.max(F.size("blocks"))).first()[0] or 0) <= n:
            return left.select(*own)
        left, n = left.withColumn("_class", F.xxhash64("_class", F.coalesce(F.get("blocks", F.lit(n)), F.lit(0)))), n + 1


def repeated_texts(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of judged (written; from judged_texts(docs)) whose whole text a smaller doc_id has as well.

    Refinement leaves the rows that may have an equal. Their whole texts are compared: grouped with map-side minima, so a common
    text moves once a task, and each text's smallest id is not repeated. Other texts stay where they are. Null ids are no ids: such a
    row is not repeated. Rows that repeat id and text are judged alike.
    """
    found = refined(judged)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    may, _ = maybe_among(texts, row_key("doc_id", "text"), key_bits(found.select("row"), "row"))
    # rows that the bitmap lets through without need are the first of a text of their own
    first = may.groupBy(F.col("_own.text").alias("text")).agg(F.min("_own.doc_id").alias("doc_id")).select("doc_id", row_key("doc_id", "text").alias("row"))
    return found.where("doc_id is not null").join(written(first.where("doc_id is not null"), "first-texts"), ["doc_id", "row"], "left_anti")


def order_table(filters: str = FILTERS) -> str:
    """All orders as JSON: name, step, the filter's bit and the bits of those before it."""
    rows = []
    for order in itertools.permutations(range(len(filters))):
        name = "".join(filters[k] for k in order)
        rows += [{"o": name, "s": step + 1, "bit": 1 << k, "before": sum(1 << x for x in order[:step])} for step, k in enumerate(order)]
    return json.dumps(rows)


def audit_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masks (part, failed bits, n, good, toxic: documents and those of them with a label) -> a row per part, order and step.

    Everything follows from the number of documents of each mask. A document that fails k filters is removed by each of them in a kth
    of all orders, which gives shapley.
    """
    entry = F.struct("failed", "n", "good", "toxic")
    sums = masks.groupBy("part", "failed").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])
    counts = sums.groupBy("part").agg(F.collect_list(entry).alias("counts"))  # at most 2 ** len(filters) entries
    orders = F.from_json(F.lit(order_table(filters)), "array<struct<o: string, s: int, bit: int, before: int>>")
    rows = counts.select("part", "counts", F.explode(orders).alias("x"))
    bit, before = F.col("x.bit"), F.col("x.before")

    def total(ok, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("counts", ok), F.lit(0).cast("long"), lambda a, c: a + value(c))

    fails = lambda c: c["failed"].bitwiseAND(bit) != 0
    gone = lambda c: c["failed"].bitwiseAND(before) != 0
    here = lambda c: fails(c) & ~gone(c)
    return rows.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.s").alias("step"),
        total(lambda c: c["failed"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["failed"] == bit).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: (c["n"] * math.factorial(len(filters)) / F.bit_count(c["failed"])).cast("long")).alias("shapley"),  # without remainder
    )


def audit_filters(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of docs under five filters.

    A to D judge a text alone (Limits), E whether a smaller doc_id has the same text. Null texts count as empty, null parts as the empty
    string. A row without id fails E never and has no label. Rows that repeat an id count each; labels that repeat one count as one,
    good or toxic if any says so; null labels say nothing. A long text is judged whole; it has a few more block hashes. Ties don't
    arise: equal texts are told apart by id, and of rows equal in both none is smaller. An empty table gives no rows. Other columns are
    not read.
    """
    judged = written(judged_texts(docs, limits, part), "judged")
    repeated = written(repeated_texts(docs, judged).select("doc_id", "part", "failed"), "repeated")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # repeated rows go over from the count of their mask to that of the mask with E
    n = lambda k: F.lit(k).cast("long").alias("k")
    with_e = F.col("failed").bitwiseOR(F.lit(REPEATED)).alias("failed")
    rows = judged.select("doc_id", "part", "failed", n(1)).unionByName(repeated.select("doc_id", "part", "failed", n(-1))).unionByName(repeated.select("doc_id", "part", with_e, n(1)))
    each = rows.groupBy("doc_id", "part", "failed").agg(F.sum("k").alias("k")).where("k <> 0").join(said, "doc_id", "left")
    count = lambda c: F.sum(F.when(F.col(c) == 1, F.col("k")).otherwise(0)).alias(c)
    masks = each.groupBy("part", "failed").agg(F.sum("k").alias("n"), count("good"), count("toxic"))
    return audit_orders(masks)
