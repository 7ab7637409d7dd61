"""Elias-Fano sequences and n-gram tries in flat arrays, searched for many keys at once."""

from __future__ import annotations

import json

import numpy as np

_EVERY = 32  # a sampled position for every so many set bits
_U = np.uint64
_ONES = _U(0x0101010101010101)
_TOPS = _U(0x8080808080808080)
_IN_BYTE = np.array([[next((p for p in range(8) if byte >> p & 1 and bin(byte & ((1 << p) - 1)).count("1") == r), 0) for r in range(8)] for byte in range(256)], np.uint64).ravel()


def _packed(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, lowest bit first, with a spare word at the end."""
    data = np.packbits(bits, bitorder="little")
    out = np.zeros(len(bits) // 64 + 2, np.uint64)
    out.view(np.uint8)[: len(data)] = data
    return out


def select(words: np.ndarray, samples: np.ndarray, k: np.ndarray, flip: int = 0) -> np.ndarray:
    """Position of the k-th (from 0) set bit; of the k-th zero if flip is all ones. k must exist."""
    pos = samples[k // _EVERY].astype(np.int64)
    left = (k % _EVERY).astype(np.int64)
    at = pos >> 6
    word = (words[at] ^ _U(flip)) & (~_U(0) << (pos & 63).astype(np.uint64))
    count = np.bitwise_count(word).astype(np.int64)
    todo = np.flatnonzero(left >= count)
    while len(todo):
        left[todo] -= count[todo]
        at[todo] += 1
        word[todo] = words[at[todo]] ^ _U(flip)
        count[todo] = np.bitwise_count(word[todo])
        todo = todo[left[todo] >= count[todo]]
    s = word - ((word >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    sums = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    r = left.astype(np.uint64)
    place = np.bitwise_count((((r * _ONES) | _TOPS) - sums) & _TOPS).astype(np.uint64) * _U(8)
    rest = r - (((sums << _U(8)) >> place) & _U(0xFF))
    return at * 64 + (place + _IN_BYTE[((((word >> place) & _U(0xFF)) << _U(3)) | rest).astype(np.intp)]).astype(np.int64)


def following(words: np.ndarray, pos: np.ndarray, flip: int = 0) -> np.ndarray:
    """Position of the first set bit after each position (-1: of the first of all); of the first zero if flip is all ones. It must exist."""
    at = (pos + 1) >> 6
    word = (words[at] ^ _U(flip)) & (~_U(0) << ((pos + 1) & 63).astype(np.uint64))
    todo = np.flatnonzero(word == 0)
    while len(todo):
        at[todo] += 1
        word[todo] = words[at[todo]] ^ _U(flip)
        todo = todo[word[todo] == 0]
    return at * 64 + np.bitwise_count((word & (~word + _U(1))) - _U(1)).astype(np.int64)


def _samples(positions: np.ndarray) -> np.ndarray:
    return positions[::_EVERY].astype(np.uint32 if not len(positions) or positions[-1] < 2**32 else np.uint64)


def ef_encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays of an Elias-Fano sequence of increasing uint64 values; the highest value fixes the split into high and low bits."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    high = (values >> _U(low)).astype(np.int64)
    bits = np.zeros(n + (top >> low) + 2, bool)
    bits[high + np.arange(n)] = True
    lows = np.zeros(n * low // 64 + 2, np.uint64)
    if low:
        at = np.arange(n, dtype=np.int64) * low
        part = values & _U((1 << low) - 1)
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(lows, at >> 6, part << shift)
        over = (at & 63) + low > 64
        np.bitwise_or.at(lows, (at[over] >> 6) + 1, part[over] >> (_U(64) - shift[over]))
    return {f"{name}.meta": np.array([n, low, top >> low], np.int64), f"{name}.high": _packed(bits), f"{name}.low": lows, f"{name}.ones": _samples(np.flatnonzero(bits)), f"{name}.zeros": _samples(np.flatnonzero(~bits))}


class EliasFano:
    """Access and search in an encoded sequence; the arrays may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low, self.top = (int(x) for x in arrays[f"{name}.meta"])
        self.words, self.lows, self.ones, self.zeros = (arrays[f"{name}.{x}"] for x in ("high", "low", "ones", "zeros"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        shift = (at & 63).astype(np.uint64)
        word = self.lows[at >> 6] >> shift
        # a shift by 64 would be undefined: shift twice
        word |= (self.lows[(at >> 6) + 1] << _U(1)) << (_U(63) - shift)
        return word & _U((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (select(self.words, self.ones, i) - i).astype(np.uint64)
        return (high << _U(self.low)) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1; the second is the next set bit, which need not be searched."""
        at = select(self.words, self.ones, i)
        after = following(self.words, at)
        one, two = (p - k for p, k in ((at, i), (after, i + 1)))
        return (one.astype(np.uint64) << _U(self.low)) | self._low(i), (two.astype(np.uint64) << _U(self.low)) | self._low(i + 1)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, within [begin, end) if given, or -1: among those that share its high bits; values are distinct."""
        out = np.full(len(x), -1, np.int64)
        high = (x >> _U(self.low)).astype(np.int64)
        ok = np.flatnonzero(high <= self.top) if self.n else np.empty(0, np.int64)
        if not len(ok):
            return out
        h = high[ok]
        zero = np.full(len(h), -1, np.int64)
        later = np.flatnonzero(h > 0)
        ones = ~0 & 0xFFFFFFFFFFFFFFFF
        zero[later] = select(self.words, self.zeros, h[later] - 1, ones)
        first = zero - h + 1
        last = following(self.words, zero, ones) - h
        if begin is not None:
            first, last = np.maximum(first, begin[ok]), np.minimum(last, end[ok])
        want = x[ok] & _U((1 << self.low) - 1)
        # binary search for the last value up to x among the low bits of the bucket; most buckets hold one
        some = np.flatnonzero(first < last)
        lo, hi, want = first[some], last[some], want[some]
        todo = np.flatnonzero(hi - lo > 1)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            upto = self._low(mid) <= want[todo]
            lo[todo[upto]] = mid[upto]
            hi[todo[~upto]] = mid[~upto]
            todo = todo[hi[todo] - lo[todo] > 1]
        hit = np.flatnonzero(self._low(lo) == want)
        out[ok[some[hit]]] = lo[hit]
        return out


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A directory, then the arrays, each from an offset divisible by 8."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, len(a)]
        body.append(data + b"\0" * (-len(data) % 8))
        at += len(body[-1])
    directory = json.dumps(head).encode()
    directory += b" " * (-len(directory) % 8)
    return len(directory).to_bytes(8, "little") + directory + b"".join(body)


def from_buffer(data: np.ndarray) -> dict[str, np.ndarray]:
    """Views into a buffer or memory map written by to_bytes."""
    n = int(data[:8].view(np.uint64)[0])
    start = 8 + n
    head = json.loads(bytes(data[8:start]))
    return {k: data[start + at : start + at + m * np.dtype(t).itemsize].view(t) for k, (t, at, m) in head.items()}


def build_level(parents: np.ndarray, n_parents: int, words: np.ndarray, probabilities: np.ndarray, width: int, name: str) -> dict[str, np.ndarray]:
    """A level of a trie: entries sorted by (parent, word), parents below n_parents, words below width.

    Pointers into the level (one per parent, and the end), words made increasing by their parent, quantised probabilities.
    """
    pointers = np.searchsorted(parents, np.arange(n_parents + 1, dtype=parents.dtype)).astype(np.uint64)
    levels = ef_encode(pointers, f"{name}.pointers") | ef_encode(parents.astype(np.uint64) * _U(width) + words, f"{name}.words")
    return levels | {f"{name}.probabilities": probabilities, f"{name}.width": np.array([width], np.int64)}


def search_level(arrays: dict[str, np.ndarray], name: str, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each (parent, word) in the level, or -1: the successor of the word between the parent's pointers.

    Keys should be sorted: each run of one parent looks up its pointers once.
    """
    if not len(parents):
        return np.empty(0, np.int64)
    run = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
    pointers = EliasFano(arrays, f"{name}.pointers")
    sizes = np.diff(np.append(run, len(parents)))
    begin, end = (np.repeat(p.astype(np.int64), sizes) for p in pointers.access_two(parents[run].astype(np.int64)))
    return EliasFano(arrays, f"{name}.words").find(parents.astype(np.uint64) * _U(int(arrays[f"{name}.width"][0])) + words, begin, end)


def build_trie(keys: np.ndarray, probabilities: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """keys: sorted context << 32 | word; words below width. The contexts that occur, and the level of their words."""
    contexts, words = keys >> _U(32), keys & _U(0xFFFFFFFF)
    unique, first = np.unique(contexts, return_index=True)
    rank = np.repeat(np.arange(len(unique), dtype=np.uint64), np.diff(np.append(first, len(keys))))
    return ef_encode(unique, "contexts") | build_level(rank, len(unique), words, probabilities, width, "two")


def search_trie(arrays: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Place of each key (sorted: context << 32 | word) among the bigrams, or -1."""
    out = np.full(len(keys), -1, np.int64)
    contexts = keys >> _U(32)
    run = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(keys) else np.empty(0, np.int64)
    rank = np.repeat(EliasFano(arrays, "contexts").find(contexts[run]), np.diff(np.append(run, len(keys))))
    seen = np.flatnonzero(rank >= 0)
    out[seen] = search_level(arrays, "two", rank[seen], keys[seen] & _U(0xFFFFFFFF))
    return out
