"""Periodic runs of words, found by partition refinement of equal factors with the smaller-half strategy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, tidied, words_of

MIN_WORDS = 24
MIN_TIMES = 3
#: Words that a task gathers to refine them together: some hundred bytes each.
CHUNK_WORDS = 1_500_000
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _sorted_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by a, b, c; packed into one number where they fit."""
    bits = [int(x.max()).bit_length() for x in (a, b, c)]
    if sum(bits) > 63:
        order = np.lexsort((c, b, a))
        return a[order], b[order], c[order]
    packed = np.sort((a << (bits[1] + bits[2])) | (b << bits[2]) | c)
    return packed >> (bits[1] + bits[2]), (packed >> bits[2]) & ((1 << bits[1]) - 1), packed & ((1 << bits[2]) - 1)


class Refinement:
    """Classes of the places of several texts at which equal factors of one length start, refined from length to length.

    Members of a class are linked in order. A class that splits hands on all its parts but the largest: only the places before
    those need be told apart at the next length, so a place is handled O(log n) times. Classes of one place are dropped.
    Places whose next member is `gap` words on wait in a bucket for the length `gap`, at which the two start a square.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, longest: np.ndarray):
        """words: numbers of the words; each text must end with a number of its own. longest: the longest period asked for at each place."""
        n = len(words)
        self.longest, self.length = longest, 1
        _, _, order = _sorted_triples(text, words, np.arange(n))
        first = np.append(True, (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1]))
        which = np.cumsum(first) - 1
        self.size = np.bincount(which)
        self.head = order[first]
        self.of, self.after, self.before = np.empty(n, np.int64), np.full(n, -1), np.full(n, -1)
        self.of[order] = which
        self._link(order, first)
        self.small, self.part = np.arange(n), self.of.copy()
        self.of[self.size[self.of] == 1] = -1
        self.used = len(self.size)
        self.moved = np.zeros(n, bool)
        self.buckets: dict[int, list[np.ndarray]] = defaultdict(list)
        self._wait(np.flatnonzero(self.of >= 0))

    def _link(self, places: np.ndarray, first: np.ndarray) -> None:
        inner = ~first[1:]
        self.after[places], self.before[places] = -1, -1
        self.after[places[:-1][inner]] = places[1:][inner]
        self.before[places[1:][inner]] = places[:-1][inner]

    def _wait(self, places: np.ndarray) -> None:
        gap = self.after[places] - places
        places = places[(gap >= self.length) & (gap <= self.longest[places])]
        if len(places):
            gap, _, places = _sorted_triples(self.after[places] - places, np.zeros(len(places), np.int64), places)
            cuts = np.flatnonzero(np.diff(gap)) + 1
            for g, own in zip(gap[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                self.buckets[g].append(own)

    def squares(self) -> np.ndarray:
        """Where squares start whose halves have the present length and are no powers, in order."""
        found = self.buckets.pop(self.length, [])
        places = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return places[self.after[places] - places == self.length]

    def grow(self) -> bool:
        """Refines to the next length at which there is anything to do; False if there is none."""
        if not len(self.small):
            if not self.buckets:
                return False
            self.length = max(self.length + 1, min(self.buckets))
            return True
        self.length += 1
        self._split()
        return True

    def _split(self) -> None:
        ok = self.small > 0
        places, part = self.small[ok] - 1, self.part[ok]
        ok = (self.of[places] >= 0) & (self.longest[places] >= self.length)
        places, part = places[ok], part[ok]
        self.small = self.part = np.empty(0, np.int64)
        if not len(places):
            return
        old, part, places = _sorted_triples(self.of[places], part, places)
        new_class = np.append(True, old[1:] != old[:-1])
        new_group = new_class | np.append(True, part[1:] != part[:-1])
        class_of_group = (np.cumsum(new_class) - 1)[new_group]
        group_size = np.diff(np.append(np.flatnonzero(new_group), len(old)))
        classes = old[new_class]
        groups = np.bincount(class_of_group)
        rest = self.size[classes] - np.diff(np.append(np.flatnonzero(new_class), len(old)))
        # classes that go over as a whole are not split
        splits = (groups > 1) | (rest > 0)
        if not splits.all():
            row = splits[np.cumsum(new_class) - 1]
            group_size, class_of_group = group_size[splits[class_of_group]], (np.cumsum(splits) - 1)[class_of_group[splits[class_of_group]]]
            old, places, new_class, new_group = old[row], places[row], new_class[row], new_group[row]
            classes, rest = classes[splits], rest[splits]
            if not len(places):
                return
        group = np.cumsum(new_group) - 1
        largest = np.maximum.reduceat(group_size, np.flatnonzero(np.append(True, np.diff(class_of_group) > 0)))
        stays = rest >= largest  # what is left is the largest part
        # one largest group of each other class is not handed on
        top = np.flatnonzero(group_size == largest[class_of_group])
        top = top[np.append(True, np.diff(class_of_group[top]) > 0)]
        handed = np.ones(len(group_size), bool)
        handed[top[~stays[class_of_group[top]]]] = False

        # stretches of moved places leave the lists of their old classes
        self.moved[places] = True
        left = (rest > 0)[np.cumsum(new_class) - 1]
        own, of = places[left], old[left]
        b, a = self.before[own], self.after[own]
        begins, ends = (b < 0) | ~self.moved[b], (a < 0) | ~self.moved[a]
        _, _, begin = _sorted_triples(of[begins], np.zeros(int(begins.sum()), np.int64), own[begins]) if len(own) else (0, 0, own)
        _, _, end = _sorted_triples(of[ends], np.zeros(int(ends.sum()), np.int64), own[ends]) if len(own) else (0, 0, own)
        self.moved[places] = False
        b, a = self.before[begin], self.after[end]
        self.after[b[b >= 0]] = a[b >= 0]
        self.before[a[a >= 0]] = b[a >= 0]
        self.head[self.of[begin[b < 0]]] = a[b < 0]
        changed = b[b >= 0]
        self.size[classes] = rest

        # the rest of a class is handed on where it is not the largest part
        small, part = [places[handed[group]]], [group[handed[group]]]
        parts = len(group_size)
        walk = np.flatnonzero((rest > 0) & ~stays)
        at, label = self.head[classes[walk]], parts + np.arange(len(walk))
        while len(at):
            small.append(at)
            part.append(label)
            at = self.after[at]
            label, at = label[at >= 0], at[at >= 0]
        self.small, self.part = np.concatenate(small), np.concatenate(part)
        self.of[self.head[classes[rest == 1]]] = -1

        # groups of several places become classes
        self._link(places, new_group)
        several = group_size > 1
        ids = np.full(len(group_size), -1)
        ids[several] = self.used + np.arange(int(several.sum()))
        self.used += int(several.sum())
        if self.used > len(self.size):
            self.size, self.head = (np.concatenate([x, np.zeros(self.used + len(x), np.int64)]) for x in (self.size, self.head))
        self.of[places] = ids[group]
        self.size[ids[several]], self.head[ids[several]] = group_size[several], places[new_group][several]
        self._wait(np.concatenate([places, changed]))


def runs_of(words: np.ndarray, text: np.ndarray, longest: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """(start, length, period) of all runs in the places of several texts, as Refinement takes them; sorted by start and period.

    A run of period q and length l has l - 2 q + 1 squares of primitive halves of length q in a row, so the first length that
    shows them is its smallest period.
    """
    found = []
    state = Refinement(words, text, longest)
    while True:
        q = state.length
        at = state.squares()
        if len(at):
            first = np.append(True, np.diff(at) > 1)
            start, count = at[first], np.diff(np.append(np.flatnonzero(first), len(at)))
            length = count + 2 * q - 1
            ok = length >= max(min_words, min_times * q)
            found.append(np.stack([start[ok], length[ok], np.full(int(ok.sum()), q)], axis=1))
        if not state.grow():
            break
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[np.ndarray], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[np.ndarray]:
    """(start, length, period) of all runs of each text, given as the numbers of its words; texts too short for one are not looked at.

    All are refined together, so that a length is gone through once for many texts.
    """
    out = [np.empty((0, 3), np.int64)] * len(texts)
    own = [k for k, w in enumerate(texts) if len(w) >= max(min_words, min_times)]
    if not own:
        return out
    sizes = np.array([len(texts[k]) + 1 for k in own])
    starts = np.cumsum(sizes) - sizes
    words = np.empty(int(sizes.sum()), np.int64)
    for k, s in zip(own, starts.tolist(), strict=True):
        words[s : s + len(texts[k])] = texts[k]
    words[starts + sizes - 1] = max(int(texts[k].max()) for k in own) + 1 + np.arange(len(own))
    found = runs_of(words, np.repeat(np.arange(len(own)), sizes), np.repeat((sizes - 1) // min_times, sizes), min_words, min_times)
    which = np.searchsorted(starts, found[:, 0], "right") - 1
    found[:, 0] -= starts[which]
    cuts = np.searchsorted(which, np.arange(len(own) + 1))
    for k, a, b in zip(own, cuts, cuts[1:], strict=False):
        out[k] = found[a:b]
    return out


def collapsed_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """words without those that any run holds after its first period."""
    if not len(runs):
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """docs plus runs (array of start, length, period; by start, then period) and collapsed (text without repetition).

    A run is a stretch of consecutive words with smallest period q and a length of at least min_words and min_times * q that no
    neighbouring word extends keeping period q; min_times is 2 or more. Words are split at ASCII white space and compared as they are. collapsed has the words
    that no run holds after its first q words, joined by one space. Every row is judged on its own: nothing is shuffled.

    Null and empty texts have no words, no runs and an empty collapsed text. Runs of several periods may overlap; all are
    given. Repeated rows are judged each. A long text is refined whole, in O(n log n) with some hundred bytes a word. An
    empty table gives an empty one. Columns named runs or collapsed are replaced, all others stay, whatever their names.
    """
    short_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = docs.select(*own).schema.add("runs", T.ArrayType(RUN)).add("collapsed", "string")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def given(held: list[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        every = runs_of_texts([n for _, _, numbers in held for n in numbers], min_words, min_times)
        for b, texts, _ in held:
            found, every = every[: len(texts)], every[len(texts) :]
            rows = np.concatenate(found)
            spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(kind.value_type))
            offsets = pa.array(np.append(0, np.cumsum([len(r) for r in found])), pa.int32())
            texts = [b" ".join(collapsed_words(words_of(t), r)) if len(r) else t for t, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, spans), pa.array(texts, pa.binary()).cast(pa.string())], names=[*own, "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ids = [], 0, _Ids()
        for b in batches:
            if not b.num_rows:
                continue
            texts, numbers = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = words_of(t or b"")
                numbers.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                texts.append(b" ".join(words))
                size += len(words)
            held.append((b, texts, numbers))
            if size >= CHUNK_WORDS:
                yield from given(held)
                held, size, ids = [], 0, _Ids()
        if held:
            yield from given(held)

    return docs.select(*[F.col(f"`{c}`") for c in own], F.col("text").cast("binary").alias("_words_of")).mapInArrow(tidied(run), schema)


def strongest_run(runs: Column) -> Column:
    """The run of greatest exact length / period; ties go to the first in order. NULL without runs."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
