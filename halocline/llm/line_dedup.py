"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, key_bits, maybe_among, row_key, written
from .runs import SortedRuns

SPACE = " \t\n\x0b\f\r"
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_id, _row, pos, h1, h2): lines whose key has at least min_chars code points, with two independent hashes of the key."""
    lines = docs.select(F.col("doc_id").alias("_id"), row_key("doc_id", "text").alias("_row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.where(F.octet_length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return keyed.select("_id", "_row", "pos", key.alias("key")).select("_id", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineIndex:
    """Incremental index of line keys: how many documents hold a key, and the largest id among them.

    path: an index that an earlier session has left, which later batches continue.
    """

    def __init__(self, spark, fanout: int = 4, path: str | None = None):
        self.runs = SortedRuns.open(spark, path) if path else SortedRuns(spark, "line_runs", ["h1", "h2"], {"n_docs": "sum", "last_id": "max"}, fanout)

    def add(self, lines: DataFrame) -> DataFrame:
        """A batch's own run. Documents of a batch must not appear in another batch.

        Returned: (h1, h2) of the batch's keys that the runs hold already or that several of its documents hold. The other
        keys are new, and the one document that holds them keeps its lines.
        """
        # the first grouping has the documents of a key, the second counts them: no task gathers a common line
        each = lines.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("_one"))
        found = self.runs.add(each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("_id").alias("last_id")))
        return found.where("seen or n_docs > 1").select("h1", "h2")

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines of a new batch that no earlier batch had."""
        return self.runs.unseen(lines)

    def repeated(self, min_docs: int, keys: DataFrame | None = None) -> DataFrame:
        """(h1, h2, n_docs, last_id) of keys that min_docs documents or more hold; keys (written, distinct): of these alone."""
        found = self.runs.compact() if keys is None else self.runs.totals(keys)
        return found.where(F.col("n_docs") >= min_docs)


def _kept_lines(lines: Column, dropped: Column) -> Column:
    """lines without the (sorted, 0-based) dropped positions: the slices between them, in time linear in both."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, index: LineIndex | None = None) -> DataFrame:
    """docs with repeated long lines removed from text, plus n_lines (before) and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of min_chars code points
    or more that min_docs documents or more hold lose all their lines but those of the largest doc_id holding them.
    Documents come in `batches` batches, the largest ids first. Each batch's keys are merge-joined with the runs: a key that no run
    holds and one document of the batch has is settled, since all documents that follow have smaller ids. The batch becomes a
    run, runs are merged level by level, and the keys left open are looked up in the runs once all batches are in.

    index: an index of earlier documents (not among docs), which count as holders but are not changed; it gains docs.
    Null or empty texts are one empty line (text becomes ''). Null ids count as one document, smaller than all.
    Rows that repeat an id count as one document; each row loses lines by the same rule. Ties can't arise: one
    document holds a key last. Long texts are split within their row; a line stands in memory a few times over. An
    empty table gives an empty one. Columns named n_lines or n_dropped are replaced, all others stay, whatever their names.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    spark = docs.sparkSession
    lowest = -(1 << 63)
    lines = long_lines(docs.select("doc_id", "text"), min_chars).withColumn("_id", F.coalesce("_id", F.lit(lowest)))
    lines = written(lines, "lines")
    cuts = lines.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    runs = index or LineIndex(spark)
    bounds = [None, *sorted(set(cuts)), None]
    open_keys = []
    for low, high in reversed(list(zip(bounds, bounds[1:], strict=False))):
        batch = lines
        batch = batch if low is None else batch.where(F.col("_id") > low)
        batch = batch if high is None else batch.where(F.col("_id") <= high)
        open_keys.append(runs.add(batch))
    keys = written(reduce(DataFrame.unionByName, open_keys).distinct(), "open-keys")
    repeated = written(runs.repeated(min_docs, keys), "repeated-lines")
    if index is None:
        runs.runs.close()
    gone = lines.alias("l").join(repeated.alias("r"), F.expr("l.h1 = r.h1 and l.h2 = r.h2 and l._id < r.last_id"), "left_semi")
    drops = written(gone.groupBy("_row").agg(F.sort_array(F.collect_set("pos")).alias("_drop")), "line-drops")
    # only rows that may lose lines are shuffled; their columns travel in a struct, so that no name can clash
    may, free = maybe_among(docs.select(*own), row_key("doc_id", "text"), key_bits(drops, "_row"))
    judged = may.join(drops.select(F.col("_row").alias("_key"), "_drop").hint("shuffle_hash"), "_key", "left").select("_own", "_drop")
    # rows without drops stay where they are
    joined = free.select(F.struct(*own).alias("_own"), F.lit(None).cast("array<int>").alias("_drop")).unionByName(judged)
    whole = F.coalesce("_own.text", F.lit(""))
    split = F.split(whole, "\n")
    text = F.when(F.col("_drop").isNull(), whole).otherwise(F.array_join(_kept_lines(split, F.col("_drop")), "\n"))
    n_lines = F.size(split).cast("long").alias("n_lines")
    n_dropped = F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"_own.`{c}`") for c in own], n_lines, n_dropped)
