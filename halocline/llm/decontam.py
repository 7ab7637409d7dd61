"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: each segment is one row that holds the postings (term -> positions) of a batch of
training documents. Queries go to every segment and start from the term that is rarest there, so a term or passage that
a third of all documents share makes no hot partition, and neither building nor searching shuffles text or postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, alnum_words_of, covered, row_key, short_batches, tidied, without_rows, written

WINDOW = 10
#: Windows sent to the executors at once (at most this many times WINDOW terms); more are searched block by block.
BLOCK_WINDOWS = 200_000
#: Segments of a row group of the written index: what a task holds when it writes and reads them, some 12 MB, however many it has.
GROUP_SEGMENTS = 4
SEGMENT = "row_ids array<long>, ids array<long>, n_words array<int>, base array<int>, terms array<long>, ends array<int>, positions array<int>, keys array<long>"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """items (item_id, text) -> (item_id, terms array<long>): every run of `window` words; shorter items are one window."""
    short_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, terms = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = hashes.of(alnum_words_of(text or b"")).view(np.int64)
                for s in range(max(1, len(h) - window + 1) if len(h) else 0):
                    ids.append(item)
                    terms.append(h[s : s + window].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tidied(run), "item_id long, terms array<long>")


class _Numbers(dict):
    """word -> its number in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _postings(texts: list[bytes | None], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """(sorted term hashes, end of each term's list, positions, first position and number of words of each text) of a batch of texts."""
    numbers, of_words, places, base, at = _Numbers(), [], [], [], 0
    for text in texts:
        words = alnum_words_of(text or b"")
        of_words.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        places.append(np.arange(at, at + len(words), dtype=np.int32))
        base.append(at)
        at += len(words) + gap
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in numbers), np.uint64, len(numbers))
    by_hash = np.argsort(hashes)
    rank = np.empty(len(hashes), np.uint16 if len(hashes) <= 1 << 16 else np.int32)
    rank[by_hash] = np.arange(len(hashes))
    ranks = rank[np.concatenate(of_words)] if of_words else rank[:0]
    order = np.argsort(ranks, kind="stable")
    positions = np.concatenate(places)[order] if places else np.empty(0, np.int32)
    return hashes[by_hash], np.cumsum(np.bincount(ranks, minlength=len(hashes))).astype(np.int32), positions, base, [len(w) for w in of_words]


def build_index(docs: DataFrame, gap: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> segments of the positional index: the postings of every word of every document.

    The index knows nothing of what will be looked up, so it serves any number of benchmarks. Positions count through a
    segment, with a gap between documents so that no window spans two. keys tell rows apart that are equal in id and
    text; they are fixed when the index is written.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, ends, positions, base, n_words = _postings(b.column(2).to_pylist(), gap)
            lists = [b.column(1), b.column(0), pa.array(n_words, pa.int32()), pa.array(base, pa.int32()), pa.array(terms.view(np.int64)), pa.array(ends), pa.array(positions), b.column(3)]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=[x.split()[0] for x in SEGMENT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("_row"), F.col("text").cast("binary"), F.monotonically_increasing_id().alias("_key"))
    return written(rows.mapInArrow(tidied(run), SEGMENT), "postings", GROUP_SEGMENTS)


class _Postings:
    """One segment's lists."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        self.terms, self.ends, self.positions = terms.view(np.uint64), ends, positions

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the directory, length of the list) of each term; the length is 0 where the segment lacks it."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, np.diff(self.ends, prepend=0)[at], 0)

    def at(self, place: int) -> np.ndarray:
        return self.positions[self.ends[place - 1] if place else 0 : self.ends[place]]


def phrase_starts(lists: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Where all lists stand in sequence: the offset-adjusted lists, intersected from the rarest on."""
    found = lists[order[0]] - order[0]
    for o in order[1:]:
        if not len(found):
            break
        other = lists[o]
        at = np.minimum(np.searchsorted(other, found + o), len(other) - 1)
        found = found[other[at] == found + o]
    return found


def near_places(lists: list[np.ndarray], order: np.ndarray, slop: int) -> np.ndarray:
    """Positions of the rarest term that have every other term within slop words on either side."""
    found = lists[order[0]]
    for o in order[1:]:
        other = lists[o]
        if not len(found):
            break
        at = np.searchsorted(other, found)
        right, left = other[np.minimum(at, len(other) - 1)], other[np.maximum(at - 1, 0)]
        found = found[np.minimum(np.abs(right - found), np.abs(left - found)) <= slop]
    return found


class _Queries:
    """A block of windows: their distinct terms, and the windows as places among these."""

    def __init__(self, block: list):
        lengths = np.array([len(r.terms) for r in block], np.int64)
        self.terms, flat = np.unique(np.array([t for r in block for t in r.terms], np.int64).view(np.uint64), return_inverse=True)
        self.flat, self.ends = flat.astype(np.int32), np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.items = [list(r["items"]) for r in block]

    def found_in(self, lists: _Postings, slop: int | None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(window, its length, where it stands), of windows that occur. A window is looked for if the segment has all its terms."""
        if not len(self.items):
            return
        at, size = lists.find(self.terms)
        for w in np.flatnonzero(np.minimum.reduceat(size[self.flat], self.starts) > 0).tolist():
            own = self.flat[self.starts[w] : self.ends[w]]
            order = np.argsort(size[own], kind="stable")  # from this segment's rarest term on
            of = [lists.at(k) for k in at[own].tolist()]
            places = phrase_starts(of, order) if slop is None else near_places(of, order, slop)
            if len(places):
                yield w, len(own) if slop is None else 1, places


def _search(segments: DataFrame, shared: Broadcast, slop: int | None) -> DataFrame:
    """(key, row_id, doc_id, n_words, n_hit, starts, lengths, items): one row per document of every segment, for a block of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for b in batches:
            for k in range(b.num_rows):
                seg = {n: b.column(b.schema.get_field_index(n))[k].values for n in b.schema.names}
                base = seg["base"].to_numpy()
                lists = _Postings(seg["terms"].to_numpy(), seg["ends"].to_numpy(), seg["positions"].to_numpy())
                starts, lengths, items = ([[] for _ in base] for _ in range(3))
                for w, length, places in queries.found_in(lists, slop):
                    of = np.searchsorted(base, places, "right") - 1
                    for doc, start in zip(of.tolist(), (places - base[of]).tolist(), strict=True):
                        starts[doc].append(start)
                        lengths[doc].append(length)
                        items[doc] += queries.items[w]
                n_words = seg["n_words"].to_pylist()
                n_hit = [int(covered(np.array(s, np.int64), np.array(m, np.int64), n).sum()) if s else 0 for s, m, n in zip(starts, lengths, n_words, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        seg["keys"], seg["row_ids"], seg["ids"], seg["n_words"], pa.array(n_hit, pa.int64()),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(lengths, pa.list_(pa.int32())),
                        pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())),
                    ],
                    names=["key", "row_id", "doc_id", "n_words", "n_hit", "starts", "lengths", "items"],
                )

    return segments.mapInArrow(tidied(run), "key long, row_id long, doc_id long, n_words int, n_hit long, starts array<int>, lengths array<int>, items array<long>")


def search_index(segments: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(row_id, doc_id, n_words, n_hit, starts, lengths, items) of every indexed document; the index may serve other items later.

    slop None: exact occurrences of item windows (starts, lengths in words). slop n: proximity matches, the places
    of a window's rarest term with all its other terms within n words, in any order. The index's gap must not be smaller
    than the window, and larger than slop. Windows are searched in blocks of BLOCK_WINDOWS, one after another, so that what the driver and the
    executors hold is bounded however large the benchmark is.
    """
    windows = written(item_windows(items, window).groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    part = F.pmod(F.xxhash64("terms"), F.lit(blocks))
    context = segments.sparkSession.sparkContext
    send = lambda k: context.broadcast(_Queries(windows.where(part == k).collect()))  # noqa: E731  BLOCK_WINDOWS or so
    if blocks == 1:
        return _search(segments, send(0), slop).drop("key")
    # several blocks, one at a time: the hits of a block are written before the next one is fetched and sent
    hits = []
    for k in range(blocks):
        shared = send(k)
        hits.append(written(_search(segments, shared, slop).where("size(starts) > 0").select("key", "starts", "lengths", "items"), "hits"))
        shared.destroy()
    # words are counted once all places of a document are together; documents without any are not grouped
    merged = {c: F.flatten(F.collect_list(c)) for c in ("starts", "lengths", "items")}
    joint = reduce(DataFrame.unionByName, hits).groupBy("key").agg(*[v.alias(c) for c, v in merged.items()])
    every = segments.select(F.inline(F.arrays_zip("keys", "row_ids", "ids", "n_words"))).toDF("key", "row_id", "doc_id", "n_words")
    none = {"starts": "array<int>", "lengths": "array<int>", "items": "array<long>"}
    both = every.join(joint, "key", "left").select("row_id", "doc_id", "n_words", *[F.array_distinct(F.coalesce(c, F.array().cast(t))).alias(c) if c == "items" else F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit = [int(covered(np.array(s, np.int64), np.array(m, np.int64), n).sum()) if s else 0 for s, m, n in zip(*(b.column(k).to_pylist() for k in (3, 4, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n_hit, pa.int64()), *b.columns[3:]], names=[x.split()[0] for x in schema.split(", ")])

    schema = "row_id long, doc_id long, n_words int, n_hit long, starts array<int>, lengths array<int>, items array<long>"
    return both.mapInArrow(tidied(count), schema)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """search_index over a new index of docs."""
    return search_index(build_index(docs, max(window, (slop or 0) + 1)), items, window, slop)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row_id, doc_id, n_words, n_hit, item_ids, contaminated), one row per document.

    Words: A-Z lower-cased runs of ASCII letters, digits and non-ASCII characters. A word inside any occurrence of an item's
    window is hit. Null and empty texts have no words and no hits; items without words have no windows; an item
    of fewer words than `window` must occur whole. Overlapping windows hit a word once, and equal windows of several items
    (ties) name them all. Repeated rows are judged each; no items: nothing is hit; no documents: no rows. item_ids are
    distinct, sorted as strings; null item ids are left out. Texts of any length are indexed whole, four bytes a word. row_id identifies
    the row of docs (a hash of id and text) for joins back; other columns are not read.
    """
    hit = matches(docs, items, window)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hit.select("row_id", "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", ids.alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated documents."""
    bad = decontaminate(docs.select("doc_id", "text"), items, window).where("contaminated").select("row_id").distinct()
    return without_rows(docs, row_key("doc_id", "text"), written(bad, "contaminated"), "row_id")
