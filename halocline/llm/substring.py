"""Substring dedup over a log-structured fingerprint index of sorted runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, covered, key_bits, maybe_among, rolling, row_key, short_batches, tidied, words_of, written
from .runs import SortedRuns

WINDOW = 50
GRAM = 16
BATCHES = 4


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all word grams, and for each window the position of the smallest in it (the leftmost of equals).

    Equal windows have their smallest gram at the same place, so they share its hash.
    """
    grams = rolling(h, gram)
    span = window - gram + 1
    places = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
    return grams, places


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _row, digest, digest2, n_words, grams array<long>, places array<int>): every document's winnowed window fingerprints.

    The digests are the halves of the MD5 of its words.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            digest, digest2, n_words, grams, places = [], [], [], [], []
            for text in b.column(2).to_pylist():
                words = words_of(text or b"")
                md5 = hashlib.md5(b" ".join(words)).digest()
                digest.append(int.from_bytes(md5[:8], "little", signed=True))
                digest2.append(int.from_bytes(md5[8:], "little", signed=True))
                n_words.append(len(words))
                if len(words) >= window:
                    g, p = _anchors(hashes.of(words), window, gram)
                    p = np.unique(p)
                    grams.append(g[p].view(np.int64))
                    places.append(p.astype(np.int32))
                else:
                    grams.append(np.empty(0, np.int64))
                    places.append(np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.int64()), pa.array(digest2, pa.int64()), pa.array(n_words, pa.int32()), pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["_id", "_row", "digest", "digest2", "n_words", "grams", "places"])

    return docs.select("_id", "_row", F.col("text").cast("binary")).mapInArrow(tidied(run), "_id long, _row long, digest long, digest2 long, n_words int, grams array<long>, places array<int>")


class FingerprintIndex:
    """Runs of (gram, smallest and largest digest of the texts that hold it): two digests tell of two different texts.

    path: an index that an earlier session has left, which later batches continue.
    """

    def __init__(self, spark, fanout: int = 4, path: str | None = None):
        self.runs = SortedRuns.open(spark, path) if path else SortedRuns(spark, "fingerprint_runs", ["gram"], {"low": "min", "high": "max"}, fanout)

    def add(self, prints: DataFrame) -> DataFrame:
        """A batch's own run. Returned: (gram) of those that the runs hold already or that different texts of the batch hold."""
        each = prints.select("digest", F.explode("grams").alias("gram"))
        found = self.runs.add(each.groupBy("gram").agg(F.min("digest").alias("low"), F.max("digest").alias("high")))
        return found.where("seen or low < high").select("gram")

    def unseen(self, prints: DataFrame) -> DataFrame:
        """Fingerprints of a new batch that no earlier batch had."""
        return self.runs.unseen(prints.select("_id", "_row", F.explode("grams").alias("gram")))

    def shared(self, keys: DataFrame | None = None) -> DataFrame:
        """(gram): fingerprints that different texts hold; keys (written, distinct): of these alone."""
        found = self.runs.compact() if keys is None else self.runs.totals(keys)
        return found.where("low < high").select("gram")


def _windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs (_id, _row, text, shared places) -> (w1, w2, _id, _row, start): every window whose fingerprint others hold too.

    The whole word sequence is hashed twice, with independent word hashes: 96 bits verify what the fingerprint suggests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = WordHashes(0), WordHashes(1)
        for b in batches:
            for i, r, text, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                words = words_of(text)
                h = one.of(words)
                _, places = _anchors(h, window, gram)
                s = np.flatnonzero(np.isin(places, np.array(at, np.int64)))
                w1, w2 = rolling(h, window)[s].view(np.int64), (rolling(two.of(words), window)[s] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(np.full(len(s), i, np.int64)), pa.array(np.full(len(s), r, np.int64)), pa.array(s.astype(np.int32))], names=["w1", "w2", "_id", "_row", "start"])

    return docs.select("_id", "_row", F.col("text").cast("binary"), "at").mapInArrow(tidied(run), "w1 long, w2 int, _id long, _row long, start int")


def removed_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """docs (_id, _row, text) -> (_row, copy boolean, starts array<int>): what goes of each row that loses words.

    copy: the whole text stands in a document with a smaller id. starts: windows that do.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs, window, gram), "fingerprints")
    # documents of one word sequence: only the first takes part in what follows, the others lose everything
    texts = prints.where(F.col("n_words") >= window).groupBy("digest", "digest2", "n_words").agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
    several = written(texts.where("first_id < last_id"), "copied-texts")
    same = F.expr("p.digest = s.digest and p.digest2 = s.digest2 and p.n_words = s.n_words and p._id > s.first_id")
    copies = written(prints.alias("p").join(several.alias("s"), same, "left_semi").select("_row").distinct(), "copies")
    cuts = prints.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    index = FingerprintIndex(spark)
    bounds = [None, *sorted(set(cuts)), None]
    open_grams = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        batch = prints
        batch = batch if low is None else batch.where(F.col("_id") > low)
        batch = batch if high is None else batch.where(F.col("_id") <= high)
        open_grams.append(index.add(batch))
    grams = written(reduce(DataFrame.unionByName, open_grams).distinct(), "open-grams")
    shared = written(index.shared(grams), "shared-fingerprints")
    index.runs.close()
    placed = prints.select("_row", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("_row", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    hot = placed.join(shared, "gram", "left_semi").groupBy("_row").agg(F.collect_set("place").alias("at"))
    hot = written(hot.join(copies, "_row", "left_anti"), "shared-places")
    may, _ = maybe_among(docs, F.col("_row"), key_bits(hot, "_row"))
    several_places = may.join(hot.withColumnRenamed("_row", "_key").hint("shuffle_hash"), "_key")
    found = written(_windows(several_places.select("_own.*", "at"), window, gram), "shared-windows")
    firsts = written(found.groupBy("w1", "w2").agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id")).where("first_id < last_id").drop("last_id"), "first-windows")
    gone = found.alias("w").join(firsts.alias("f"), F.expr("w.w1 = f.w1 and w.w2 = f.w2 and w._id > f.first_id"), "left_semi")
    starts = gone.groupBy("_row").agg(F.collect_set("start").alias("starts"))
    whole = copies.select("_row", F.lit(True).alias("copy"))
    return written(starts.join(whole, "_row", "full_outer"), "removals")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): docs without the words of windows that start in a document with a smaller id.

    A window is `window` consecutive words (split at ASCII white space) of one document; windows are judged on the
    input. kept: the words that stay, joined by one space. Fingerprints are winnowed: the smallest hash of `gram`
    words in each window. Two equal windows share it, so only windows around fingerprints that two different texts hold
    are hashed whole and compared; nothing is lost. Documents come in `batches` batches, the smallest ids first. Each
    batch's fingerprints are merge-joined with the runs: one that no run holds and one text of the batch has is settled
    unless a later batch meets it. The batch becomes a run, runs are merged level by level, and what the joins left open is
    looked up in the runs once all batches are in.

    Null and empty texts have no words. Null ids count as smaller than all others. Rows that repeat an id are one
    document: they do not remove words from each other. Shorter documents never lose words. Of equal windows, whose ties the
    id breaks, only those in the smallest id stay. A long text is held with eight bytes a word a few times over. An empty
    table gives an empty one. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    lowest = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("_id"), row_key("doc_id", "text").alias("_row"), "text")
    gone = removed_windows(rows.drop("doc_id"), window, gram, batches)
    # only texts that may lose words are shuffled
    may, free = maybe_among(rows.select("doc_id", "text", "_row"), F.col("_row"), key_bits(gone, "_row"))
    may = may.join(gone.withColumnRenamed("_row", "_key").hint("shuffle_hash"), "_key", "left").select("_own.doc_id", "_own.text", "copy", "starts")
    free = free.select("doc_id", "text", F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    judged = may.unionByName(free).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "copy", "starts")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            n_words, n_removed, kept = [], [], []
            for text, copy, starts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = words_of(text or b"")
                n_words.append(len(words))
                if copy:
                    n_removed.append(len(words))
                    words = []
                elif starts:
                    out = covered(np.array(starts, np.int64), window, len(words))
                    n_removed.append(int(out.sum()))
                    words = [words[k] for k in np.flatnonzero(~out)]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return judged.mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept string")
