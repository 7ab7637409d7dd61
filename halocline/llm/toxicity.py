"""Toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT_WORDS, alnum_words_of, short_batches, tidied, written

#: Bounds of the fit (documented parameters): labelled rows and features used.
MAX_LABELLED = 20_000
MAX_FEATURES = 5_000
#: A feature must occur in so many toxic documents, in such a share of them, and so much more often there than in the others.
MIN_DOCS = 5
MIN_SHARE = 0.005
MIN_RATIO = 8.0
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.5


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings, so that inflected forms share features."""
    text = word.decode("utf-8", "replace")
    names = [b"w" + word] + [b"p" + text[:n].encode() for n in PREFIXES if len(text) > n]
    return tuple(xxhash.xxh64_intdigest(x, 0) >> 1 for x in names)


class _Places(dict):
    """word -> number of its list of feature positions; 0 for words without features. `of` gives a word's positions."""

    def __init__(self, of):
        self.of = of
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.lists: list[tuple[int, ...]] = [()]

    def __missing__(self, word: bytes) -> int:
        found = self.of(word)
        if found:
            self.lists.append(found)
        value = self[word] = len(self.lists) - 1 if found else 0
        return value

    def sparse(self, texts: list[bytes | None], once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature position, count) of every feature that occurs in a text, and each text's number of words.

        once: a word counts once in a text. Looked-up words are forgotten beyond a bound.
        """
        if len(self) >= KEPT_WORDS:
            self.forget()
        found, n_words = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = alnum_words_of(text or b"")
            n_words[k] = len(words)
            words = set(words) if once else words
            found.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        numbers = np.concatenate(found) if found else np.empty(0, np.int32)
        at = np.flatnonzero(numbers)
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in found])[at]
        sizes = np.array([len(x) for x in self.lists])
        flat = np.array([c for x in self.lists for c in x], np.int64)
        starts, n = (np.cumsum(sizes) - sizes)[numbers[at]], sizes[numbers[at]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cols = flat[np.repeat(starts, n) + inner]
        pairs, counts = np.unique(np.repeat(rows, n) << 32 | cols, return_counts=True)
        return pairs >> 32, pairs & 0xFFFFFFFF, counts, n_words


def selected_places(selected: dict[int, int]) -> _Places:
    """Of the selected features alone."""
    return _Places(lambda word: tuple(selected[f] for f in features_of(word) if f in selected))


def length_term(n_words: np.ndarray) -> np.ndarray:
    """A feature of every text, so that a long text's greater chance to hold some feature can be offset."""
    return np.log1p(n_words) / 10


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - x . weights): one weight vector for all ordered thresholds."""

    features: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, texts: list[bytes | None], places: _Places) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text: a row each. The last weight is that of the text's length."""
        rows, cols, counts, n_words = places.sparse(texts)
        score = np.bincount(rows, np.log1p(counts) * self.weights[cols], len(texts)) + length_term(n_words) * self.weights[-1]
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = 0.1, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the cumulative logit model, by Adam on the penalised mean log likelihood."""
    n, levels = len(grades), int(grades.max()) + 1 if len(grades) else 1
    share = np.clip([(grades <= k).mean() for k in range(levels - 1)], 1e-6, 1 - 1e-6) if levels > 1 else np.empty(0)
    start = np.log(share / (1 - share)) if levels > 1 else np.empty(0)
    if levels < 2:
        return np.zeros(n_features), start
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    p = np.concatenate([np.zeros(n_features), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, theta = p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])
        eta = np.bincount(rows, values * w[cols], n)
        s = 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -500, 500)))
        s = np.column_stack([np.zeros(n), s, np.ones(n)])
        d = s * (1 - s)
        at = np.arange(n)
        chance = np.maximum(s[at, grades + 1] - s[at, grades], 1e-12)
        up, down = d[at, grades + 1] / chance, d[at, grades] / chance
        by_eta = (up - down) / n  # of the negative log likelihood
        by_theta = np.array([(down[grades == k + 1].sum() - up[grades == k].sum()) / n for k in range(levels - 1)])
        later = np.cumsum(by_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, values * by_eta[rows], n_features) + penalty * w / n, later[:1], later[1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fits severity grades on at most max_labelled labelled documents, chosen by a hash of the id.

    labels (doc_id, severity) gives grades from 0 on; labels (doc_id, toxic) without that column gives two, 0 and 1, so that a
    single threshold is left. Indicative features occur in MIN_DOCS documents of a grade above 0 and MIN_SHARE of them or more,
    and MIN_RATIO times as often there as in the others. They are counted by Spark; only the selected ones, max_features at
    most, and the sample's counts of them come to the driver.
    """
    spark = docs.sparkSession
    short_batches(spark)
    grade = "severity" if "severity" in labels.columns else "toxic"
    known = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).groupBy("doc_id").agg(F.greatest(F.lit(0), F.max(grade).cast("int")).alias("grade"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "graded-labels")
    sample = docs.select("doc_id", F.col("text").cast("binary")).join(F.broadcast(chosen), "doc_id").select("text", "grade")  # max_labelled rows
    sample = written(sample, "graded-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names: dict[int, int] = {}
            places = _Places(lambda word, names=names: tuple({names.setdefault(f, len(names)) for f in features_of(word)}))
            rows, cols, _, _ = places.sparse(b.column(0).to_pylist(), once=True)
            toxic = b.column(1).to_numpy() > 0
            # features of clean documents matter only beside those of toxic ones, but these may be in other batches
            by = [np.bincount(cols[of], minlength=len(names)) for of in (toxic[rows], ~toxic[rows])]
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.int64()), *map(pa.array, by)], names=["f", "toxic", "clean"])

    sizes = sample.groupBy("grade").count().collect()  # one row per grade
    n_toxic, n_clean = (sum(r["count"] for r in sizes if (r.grade > 0) == x) for x in (True, False))
    counts = sample.mapInArrow(tidied(count), "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1.0)) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    best = counts.where(F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * n_toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    top = best.orderBy(F.desc(F.col("toxic") * F.log("ratio")), "f").limit(max_features).collect()
    selected = {r.f: k for k, r in enumerate(top)}
    shared = spark.sparkContext.broadcast(selected)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = selected_places(shared.value)
        for b in batches:
            rows, cols, n, n_words = own.sparse(b.column(0).to_pylist())
            ends = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cols, n)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n_words), *lists], names=["grade", "n_words", "cols", "n"])

    data = sample.mapInArrow(tidied(sparse), "grade int, n_words long, cols array<int>, n array<int>").collect()  # max_labelled sparse rows
    shared.destroy()
    grades = np.array([r.grade for r in data], np.int64)
    every = np.arange(len(data))
    rows = np.concatenate([np.repeat(every, [len(r.cols) for r in data]), every]).astype(np.int64)
    cols = np.concatenate([np.array([c for r in data for c in r.cols], np.int64), np.full(len(data), len(selected), np.int64)])
    values = np.concatenate([np.log1p(np.array([x for r in data for x in r.n], np.float64)), length_term(np.array([r.n_words for r in data], np.float64))])
    weights, thresholds = fit_ordinal(rows, cols, values, grades, len(selected) + 1)
    return OrdinalModel(selected, weights, thresholds)


def severity(text: Column, model: OrdinalModel, spark) -> Column:
    """struct<severity double, grade int, p_toxic double> of a text column. severity: the expected grade."""
    shared = spark.sparkContext.broadcast(model)  # MAX_FEATURES weights

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        places = selected_places(fitted.features)
        for texts in batches:
            tail = fitted.at_least(texts.to_pylist(), places)
            edges = np.column_stack([np.ones(len(tail)), tail, np.zeros(len(tail))])
            mass = edges[:, :-1] - edges[:, 1:]
            first = tail[:, 0] if tail.shape[1] else np.zeros(len(tail))
            yield pa.StructArray.from_arrays([pa.array(tail.sum(axis=1)), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(first)], names=["severity", "grade", "p_toxic"])

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(run)(batches)

    return F.arrow_udf(score, "severity double, grade int, p_toxic double")(text.cast("binary"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every document, from its whole text.

    severity is the expected grade, grade the likeliest one (ties: the lower). toxic: a grade of 1 or more has at least the
    probability `threshold`. Null and empty texts have no features and get the base rate; long texts are scored whole, by counts
    and a length term. Without labels above grade 0 nothing is toxic; no documents give no rows. A document labelled several times
    counts with its highest label; null labels are left out. Repeated rows are scored each; other columns are not read.
    """
    model = fit_toxicity(docs, labels, **bounds)
    scored = docs.select(F.col("doc_id").cast("long"), severity(F.col("text"), model, docs.sparkSession).alias("s"))
    return scored.select("doc_id", "s.severity", "s.grade", "s.p_toxic", (F.col("s.p_toxic") >= threshold).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """docs without the toxic documents; all columns as they are."""
    model = fit_toxicity(docs, labels, **bounds)
    # the rows' own columns travel in a struct, so that none of their names can clash
    scored = docs.select(F.struct("*").alias("own"), severity(F.col("text"), model, docs.sparkSession).alias("s"))
    return scored.where(F.col("s.p_toxic") < threshold).select("own.*")
