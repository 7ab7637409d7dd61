"""Language-model scoring with an Elias-Fano n-gram trie.

Counts are gathered by Spark; the model is written as memory-mapped levels into the shared folder: a unigram level, sharded
by ranges of word hashes, and tries (word -> second words -> third words) sharded by a hash of the bigram, so that no context,
however frequent, makes a large shard. Shards hold a bounded number of entries; there are more of them for a larger corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, new_path, short_batches, tidied, written
from .elias_fano import EliasFano, build_level, build_trie, ef_encode, from_buffer, search_level, search_trie, to_bytes

#: Entries of a shard of the unigram level, and tokens that a shard of the tries stands for.
SHARD_WORDS = 1_000_000
SHARD_TOKENS = 2_000_000
#: Distinct n-grams that a task gathers before it hands them on.
HELD = 4_000_000
#: Longest n-grams.
ORDER = 3
#: Steps of a quantised log10 probability; 16 bits hold down to -16.
STEP = 4096
_BINS = 40
#: Bytes of texts that are split into words at once.
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A random number for each byte; a byte's share in its word's hash is this number times a power of an odd number by its place.
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_PLACES = [np.ones(1, np.uint64)]
#: Stands for the end of a text; no UTF-8 has this byte.
_END = b" \xff "


def _powers(n: int) -> np.ndarray:
    if len(_PLACES[0]) < n:
        p = np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)
        p[0] = 1
        _PLACES[0] = np.cumprod(p)
    return _PLACES[0]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words (split at ASCII white space) of a buffer, in order."""
    raw = np.frombuffer(data, np.uint8)
    inner = np.flatnonzero(~_SPACE[raw])
    if not len(inner):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.append(True, np.diff(inner) > 1))
    sizes = np.diff(np.append(first, len(inner)))
    place = np.arange(len(inner)) - np.repeat(first, sizes)
    return mixed(np.add.reduceat(_BYTES[raw[inner]] * _powers(int(sizes.max()))[place], first))


END = int(word_hashes(_END)[0])


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased (A-Z) words of all texts, each followed by the end; the number of tokens of each text)."""
    parts, chunk, size = [], [], 0
    for text in texts:
        chunk.append(text or b"")
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            parts.append(word_hashes((_END.join(chunk) + _END).translate(_LOWER)))
            chunk, size = [], 0
    if chunk:
        parts.append(word_hashes((_END.join(chunk) + _END).translate(_LOWER)))
    found = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return found, np.diff(np.flatnonzero(found == np.uint64(END)), prepend=-1)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _put(path: str, arrays: dict[str, np.ndarray]) -> str:
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(to_bytes(arrays))
    return name


#: Bytes of shards that a worker keeps where they can't be mapped.
KEPT_BYTES = 256 << 20
_opened: dict[str, dict[str, np.ndarray]] = {}


def _get(path: str, name: str) -> dict[str, np.ndarray]:
    """A shard's arrays: memory-mapped where the folder is mounted, else read, a few at a time."""
    key = f"{path}/{name}"
    if key not in _opened:
        store, root = _store(path)
        local = isinstance(store, fs.LocalFileSystem)
        held = len(_opened) * (1 << 16) if local else sum(a.nbytes for x in _opened.values() for a in x.values())
        if held >= KEPT_BYTES:
            _opened.clear()
        data = np.memmap(f"{root}/{name}", np.uint8, "r").view(np.ndarray) if local else np.frombuffer(store.open_input_file(f"{root}/{name}").read_buffer(), np.uint8)
        _opened[key] = from_buffer(data)
    return _opened[key]


@dataclass
class Unigrams:
    """Sorted word hashes by range, with counts. A word's id is its rank among all."""

    path: str
    names: list[str]
    offsets: list[int]
    total: int

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of each hash."""
        unique, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        shard = shard_of_hash(unique, len(self.names))
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            if not self.names[s]:
                continue
            arrays = _get(self.path, self.names[s])
            at = EliasFano(arrays, "words").find(unique[own])
            hit = np.flatnonzero(at >= 0)
            ids[own[hit]] = at[hit] + self.offsets[s]
            counts[own[hit]] = arrays["counts"][at[hit]]
        return ids[back], counts[back]


def shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of equal width of the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of the shards that occur; places keep their order."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")  # 16 bits are sorted by radix
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(shard[own[0]]), own


@dataclass
class Places:
    """Where the bigrams of a batch stand: per distinct bigram its shard, place (or -1), and quantised values of its entry."""

    shard: np.ndarray
    at: np.ndarray
    probability: np.ndarray
    often: np.ndarray


@dataclass
class LanguageModel:
    """P(w | h) = (1 - lambda) c(hw) / c(h) + beta P(w | shorter h), for words and bigrams h; P(w) by adding one.

    lambda goes by the size of c(h). Trigrams seen once are not kept; beta is what the kept ones leave, so that
    probabilities still add up to 1.
    """

    unigrams: Unigrams
    path: str
    names: list[str]
    backoff: np.ndarray
    third: list[str] | None = None

    def bigrams(self, keys: np.ndarray) -> Places:
        """keys: sorted, distinct."""
        shard = shard_of_hash(mixed(keys), len(self.names))
        at, p, often = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for s, own in by_shard(shard):
            if self.names[s]:
                arrays = _get(self.path, self.names[s])
                at[own] = search_trie(arrays, keys[own])
                hit = own[at[own] >= 0]
                p[hit], often[hit] = arrays["two.probabilities"][at[hit]], arrays["often"][at[hit]]
        return Places(shard, at, p, often)

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions with a known word before them in their text and a known word, their distinct bigrams, which one each is)."""
        before = np.roll(ids, 1)
        before[starts] = -1
        known = np.flatnonzero((before >= 0) & (ids >= 0))
        keys, which = np.unique(bigram_keys(before[known], ids[known]), return_inverse=True)
        return known, keys, which

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base and score (log10) of each text."""
        tokens, lengths = token_hashes(texts)
        starts = np.cumsum(lengths) - lengths
        ids, counts = self.unigrams.find(tokens)
        uni = self.unigrams
        base = np.log10((counts + 1) / (uni.total + 1 * (uni.size + 1)))
        best = base.copy()
        # after a known word; the first token of a text has none before it
        before = np.roll(ids, 1)
        before[starts] = -1
        after = np.flatnonzero(before >= 0)
        best[after] += np.log10(self.backoff)[bin_of(np.roll(counts, 1)[after])]
        known, keys, which = self.contexts(ids, starts)
        found = self.bigrams(keys)
        hit = found.at[which] >= 0
        best[known[hit]] = -found.probability[which[hit]] / STEP
        if self.third is not None:
            self._third(ids, starts, known[hit], which[hit], found, best)
        add = lambda x: np.add.reduceat(x, starts)
        return {"n_tokens": lengths, "n_known": add((counts > 0).astype(np.int64)), "base": add(base), "score": add(best)}

    def _third(self, ids: np.ndarray, starts: np.ndarray, known: np.ndarray, which: np.ndarray, found: Places, best: np.ndarray) -> None:
        """Scores of the tokens that follow a bigram with kept trigrams, from the trie's third level."""
        of = np.full(len(ids) + 1, -1, np.int64)
        of[known + 1] = which  # the bigram before each position
        of[starts] = -1
        of = of[:-1]
        after = np.flatnonzero(of >= 0)
        after = after[found.often[of[after]]]
        for s, own in by_shard(found.shard[of[after]]):
            if not self.third[s]:
                continue
            arrays = _get(self.path, self.third[s])
            at = after[own]
            parent = found.at[of[at]]
            beta = arrays["backoffs"][parent] / -STEP
            best[at] += beta
            some = np.flatnonzero(ids[at] >= 0)
            keys, back = np.unique((parent[some].astype(np.uint64) << np.uint64(32)) | ids[at[some]].astype(np.uint64), return_inverse=True)
            place = search_level(arrays, "three", keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF))[back]
            seen = np.flatnonzero(place >= 0)
            best[at[some[seen]]] = arrays["three.probabilities"][place[seen]] / -STEP


def bigram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def bin_of(counts: np.ndarray) -> np.ndarray:
    """Classes of context counts: powers of two."""
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), _BINS - 1)


class _Held:
    """Distinct keys with counts, gathered up to a bound."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        unique, n = np.unique(keys, return_counts=True)
        self.parts.append((unique, n))
        self.size += len(unique)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        unique, back = np.unique(keys, return_inverse=True)
        return unique, np.bincount(back, n, len(unique)).astype(np.int64)

    def full(self) -> bool:
        if self.size >= HELD:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
        return self.size >= HELD // 2

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged() if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.size = [], 0
        return out


def fit_unigrams(training: DataFrame, path: str) -> Unigrams:
    """training (text binary) -> the unigram level, written below path."""
    spark = training.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        give = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["w", "n"])
        for b in batches:
            if b.num_rows:
                held.add(token_hashes(b.column(0).to_pylist())[0])
                if held.full():
                    yield give(*held.taken())
        yield give(*held.taken())

    counts = written(training.mapInArrow(tidied(count), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "unigrams")
    size, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-size // SHARD_WORDS))
    shard = F.shiftrightunsigned(F.shiftrightunsigned("w", 32) * F.lit(shards).cast("long"), 32).cast("int")

    def level(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, n = rows["w"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        order = np.argsort(w)
        name = _put(path, ef_encode(w[order], "words") | {"counts": n[order].astype(np.uint32 if n.max() < 2**32 else np.int64)})
        return pd.DataFrame({"shard": [key[0]], "name": [name], "n": [len(w)]})

    levels = written(counts.select("w", "n", shard.alias("shard")).groupBy("shard").applyInPandas(level, "shard int, name string, n long"), "unigram-levels")
    names, sizes = [""] * shards, [0] * shards
    for r in levels.collect():  # one row per shard
        names[r.shard], sizes[r.shard] = r["name"], r.n
    return Unigrams(path, names, [0, *np.cumsum(sizes).tolist()], int(total))


def fit_model(training: DataFrame, order: int = ORDER) -> LanguageModel:
    """training (text) -> a trigram model. A vocabulary of 2^32 words or more raises ValueError.

    lambda, the chance that a context is followed by something new, is estimated for each class of context counts by leaving
    one out: the n-grams seen once, over the tokens of the class.
    """
    spark = training.sparkSession
    short_batches(spark)
    training = training.select(F.col("text").cast("binary"))
    path = new_path(spark, "ngrams")
    unigrams = fit_unigrams(training, path)
    if unigrams.size >= 1 << 32:
        raise ValueError("more words than ids")
    shards = max(1, -(-unigrams.total // SHARD_TOKENS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def give() -> pa.RecordBatch:
            keys, n = held.taken()
            rows: list[list] = [[], [], [], []]
            for s, own in by_shard(shard_of_hash(mixed(keys), shards)):
                k = keys[own]
                # contexts as differences, which are small; words and counts as they are
                for column, a in zip(rows, (None, np.diff(k >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32), (k & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[own].astype(np.uint32)), strict=True):
                    column.append(s if a is None else a.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["shard", "contexts", "words", "counts"])

        for b in batches:
            if b.num_rows:
                tokens, lengths = token_hashes(b.column(0).to_pylist())
                ids, _ = unigrams.find(tokens)
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(lengths) - lengths] = False  # a text's first token has no context
                word = np.flatnonzero(inner)
                held.add(bigram_keys(ids[word - 1], ids[word]))
                if held.full():
                    yield give()
        yield give()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = _Held()
        for c, w, n in zip(rows["contexts"], rows["words"], rows["counts"], strict=True):
            contexts = np.cumsum(np.frombuffer(c, np.uint32), dtype=np.uint64)
            held.parts.append(((contexts << np.uint64(32)) | np.frombuffer(w, np.uint32).astype(np.uint64), np.frombuffer(n, np.uint32)))
        keys, n = held.merged()
        _, of_context = ids_counts(unigrams, keys >> np.uint64(32))
        bins = bin_of(of_context)
        once, tokens = np.bincount(bins[n == 1], minlength=_BINS), np.bincount(bins, n, _BINS).astype(np.int64)
        contexts = np.diff(keys >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32)
        return pd.DataFrame({"shard": [key[0]], "contexts": [contexts.tobytes()], "words": [(keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()], "counts": [n.astype(np.uint32).tobytes()], "once": [once.tolist()], "tokens": [tokens.tolist()]})

    blobs = "shard int, contexts binary, words binary, counts binary"
    merged = training.mapInArrow(tidied(count), blobs).groupBy("shard").applyInPandas(merge, f"{blobs}, once array<long>, tokens array<long>")
    merged = written(merged, "bigrams")
    sums = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("once", "tokens") for k in range(_BINS)]
    total = merged.agg(*sums).first()
    once, tokens = (np.array([total[f"{c}{k}"] or 0 for k in range(_BINS)], np.float64) for c in ("once", "tokens"))
    backoff = np.clip((once + 0.5) / (tokens + 1), 0.001, 0.999)

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = []
            for c, w, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                contexts = np.cumsum(np.frombuffer(c, np.uint32), dtype=np.uint64)
                words, count_ = np.frombuffer(w, np.uint32).astype(np.uint64), np.frombuffer(n, np.uint32)
                _, of_context = ids_counts(unigrams, contexts)
                _, of_word = ids_counts(unigrams, words)
                new = backoff[bin_of(of_context)]
                p = (1 - new) * count_ / of_context + new * (of_word + 1) / (unigrams.total + unigrams.size + 1)
                names.append(_put(path, build_trie((contexts << np.uint64(32)) | words, quantised(p), unigrams.size) | {"often": count_ > 1}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], names=["shard", "name"])

    names = [""] * shards
    for r in written(merged.select("shard", "contexts", "words", "counts").mapInArrow(tidied(tries), "shard int, name string"), "tries").collect():  # one row per shard
        names[r.shard] = r["name"]
    model = LanguageModel(unigrams, path, names, backoff)
    model.third = fit_third(training, model, merged) if order > 2 else None
    return model


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEP), 65535).astype(np.uint16)


def fit_third(training: DataFrame, model: LanguageModel, merged: DataFrame) -> list[str]:
    """The third level of every shard's trie; merged: the counts of the bigrams by shard.

    A trigram that occurs twice has two bigrams that do. So tokens are looked up in the finished second level, and only
    trigrams of such bigrams are counted, by the place of their first bigram; those seen once are then left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Held] = {}

        def give() -> pa.RecordBatch:
            rows: list[list] = [[], [], []]
            for s, own in held.items():
                keys, n = own.taken()
                for column, value in zip(rows, (s, keys.tobytes(), n.astype(np.uint32).tobytes()), strict=True):
                    column.append(value)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["shard", "keys", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            tokens, lengths = token_hashes(b.column(0).to_pylist())
            ids, _ = model.unigrams.find(tokens)
            known, keys, which = model.contexts(ids, np.cumsum(lengths) - lengths)
            found = model.bigrams(keys)
            of = np.full(len(ids), -1, np.int64)
            of[known] = which
            # two bigrams in a row: the second starts with the word that the first ends with
            at = np.flatnonzero((of[1:] >= 0) & (of[:-1] >= 0)) + 1
            at = at[found.often[of[at]] & found.often[of[at - 1]]]
            parent = of[at - 1]
            for s, own in by_shard(found.shard[parent]):
                held.setdefault(s, _Held()).add((found.at[parent[own]].astype(np.uint64) << np.uint64(32)) | ids[at[own]].astype(np.uint64))
            if sum(x.size for x in held.values()) >= HELD // 2:
                yield give()
        yield give()

    def merge(key: tuple, rows: pd.DataFrame, bigrams: pd.DataFrame) -> pd.DataFrame:
        held = _Held()
        for k, n in zip(rows["keys"], rows["counts"], strict=True):
            held.parts.append((np.frombuffer(k, np.uint64), np.frombuffer(n, np.uint32)))
        keys, n = held.merged() if held.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keys, n = keys[n > 1], n[n > 1]
        of, second = (np.frombuffer(bigrams[c].iloc[0], np.uint32).astype(np.int64) for c in ("counts", "words"))
        kept = np.bincount((keys >> np.uint64(32)).astype(np.int64), n, len(of)).astype(np.int64)
        # of a bigram's occurrences all that are not in a kept trigram are followed by something that follows once
        several = np.flatnonzero((of > 1) & (second != end))  # nothing follows the end
        bins = bin_of(of[several])
        once, tokens = (np.bincount(bins, x, _BINS).astype(np.int64) for x in (of[several] - kept[several], of[several]))
        return pd.DataFrame({"shard": [key[0]], "keys": [keys.tobytes()], "n3": [n.astype(np.uint32).tobytes()], "once": [once.tolist()], "tokens": [tokens.tolist()]})

    end = int(model.unigrams.find(np.array([END], np.uint64))[0][0])
    seen = training.mapInArrow(tidied(count), "shard int, keys binary, counts binary")
    own = merged.select("shard", "words", "counts")
    third = seen.groupBy("shard").cogroup(own.groupBy("shard")).applyInPandas(merge, "shard int, keys binary, n3 binary, once array<long>, tokens array<long>")
    third = written(third, "trigrams")
    total = third.agg(*[F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("once", "tokens") for k in range(_BINS)]).first()
    once, tokens = (np.array([total[f"{c}{k}"] or 0 for k in range(_BINS)], np.float64) for c in ("once", "tokens"))
    new = np.clip((once + 0.5) / (tokens + 1), 0.001, 0.999)
    model.third = None
    uni = model.unigrams

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = []
            for keys, n, words, counts in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                keys, n = np.frombuffer(keys, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)
                second, of = np.frombuffer(words, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64)
                parent, third_words = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
                kept = np.bincount(parent, n, len(of))
                lam = new[bin_of(of)]
                # followed by the end alone, or seen once: nothing is kept, and the shorter context decides
                beta = np.where(of > 1, 1 - (1 - lam) * kept / of, 1.0)
                pairs, back = np.unique(bigram_keys(second[parent], third_words), return_inverse=True)
                shorter = 10.0 ** (-model.bigrams(pairs).probability[back] / STEP)
                p = (1 - lam[parent]) * n / of[parent] + beta[parent] * shorter
                names.append(_put(model.path, build_level(parent.astype(np.uint64), len(of), third_words, quantised(p), uni.size, "three") | {"backoffs": quantised(beta)}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], names=["shard", "name"])

    rows = third.select("shard", "keys", "n3").join(own, "shard").select("shard", "keys", "n3", "words", "counts")
    names = [""] * len(model.names)
    for r in written(rows.mapInArrow(tidied(level), "shard int, name string"), "third-levels").collect():  # one row per shard
        names[r.shard] = r["name"]
    return names


def ids_counts(unigrams: Unigrams, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, count) of words given by id."""
    counts = np.zeros(len(ids), np.int64)
    bounds = np.array(unigrams.offsets, np.int64)
    shard = np.searchsorted(bounds, ids.astype(np.int64), "right") - 1
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        counts[own] = _get(unigrams.path, unigrams.names[s])["counts"][ids[own].astype(np.int64) - bounds[s]]
    return ids, counts


def score_documents(docs: DataFrame, held_out: int = 2, folds: int = 7, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, from its whole text.

    The model learns from documents whose crc32(doc_id as text) modulo `folds` is not `held_out`. Tokens are the words, A-Z lower-cased,
    and an end. base_score adds log10((c + 1) / (N + V + 1)); score adds the model's log10 probabilities, quantised to
    1 / STEP. Null and empty texts are an end alone. A null id is hashed as the empty text. Repeated rows count, and are
    scored, each. Long texts are scored whole, with some dozens of bytes a token. Equal n-grams have equal scores, so
    ties don't arise. An empty table gives no rows. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col("doc_id").cast("long"), (fold == held_out).alias("held_out"), F.col("text").cast("binary").alias("text"))
    model = fit_model(rows.where(~F.col("held_out")).select("text"), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = model.score(b.column(2).to_pylist())
                total = pa.array(np.full(b.num_rows, model.unigrams.total, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found["n_tokens"].astype(np.int64)), pa.array(found["n_known"]), total, pa.array(found["base"]), pa.array(found["score"])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
