import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from halocline.llm import periodic_runs
from halocline.llm.periodic_runs import Refinement, find_runs
from halocline.llm.queries import op12_periodic_runs

from .helpers import EXTRA, docs


def brute(words, min_words=24, min_times=3):
    """All maximal stretches of every period, smallest period first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // min_times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_times * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted((s, l, q) for s, l, q in out)


def runs_of_texts(texts, *limits):
    numbers = {}
    return periodic_runs.runs_of_texts([np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts], *limits)


def some_words(rng):
    letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
    words = [rng.choice(letters) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(3)):
        root = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (root * rng.randrange(1, 9))[: rng.randrange(1, 90)]
    return words


@pytest.mark.parametrize("least,times", [(1, 2), (6, 2), (24, 3), (1, 3)])
def test_all_runs(least, times):
    rng = random.Random(least * 10 + times)
    texts = [some_words(rng) for _ in range(400)] + [list("a" * 100), list("ab" * 70), [], ["x"]]
    found = runs_of_texts(texts, least, times)
    for t, f in zip(texts, found, strict=True):
        assert [tuple(r) for r in f.tolist()] == brute(t, least, times)


def test_smaller_halves_bound_the_work():
    """Places handled grow as n log n, whatever the text."""
    for make in (lambda n: np.zeros(n, np.int64), lambda n: np.arange(n) % 7, lambda n: np.random.default_rng(1).integers(0, 2, n)):
        handled = []
        for n in (2000, 8000):
            w = np.append(make(n), 10)
            state, total = Refinement(w, np.zeros(n + 1, np.int64), np.full(n + 1, n // 3)), 0
            while True:
                total += len(state.small)
                state.squares()
                if not state.grow():
                    break
            handled.append(total)
        assert handled[1] <= 8 * max(handled[0], 2000)


def test_rows_of_every_kind(spark):
    text = "a b " + "x y z " * 12 + "tail"
    d = docs(spark, [(1, text), (1, text), (2, None), (3, ""), (None, " \t" + "w\n" * 30), (4, "é " * 24), (5, "é " * 23)], EXTRA).withColumnRenamed("n_lines", "runs")
    got = find_runs(d)
    assert got.columns == [c for c in d.columns if c != "runs"] + ["runs", "collapsed"]
    rows = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in got.collect()}
    assert got.count() == 7 and len(rows) == 6
    assert rows[1, text] == ([(2, 36, 3)], "a b x y z tail")
    assert rows[2, None] == rows[3, ""] == ([], "")
    assert rows[None, " \t" + "w\n" * 30] == ([(0, 30, 1)], "w")
    assert rows[4, "é " * 24] == ([(0, 24, 1)], "é") and rows[5, "é " * 23] == ([], ("é " * 23).strip())
    assert find_runs(docs(spark, [])).count() == 0


def test_long_text():
    n = 500_000
    [found, _] = runs_of_texts([[*range(n - 60_000), *(k % 20_000 for k in range(60_000))], ["a"] * 30])
    assert found.tolist() == [[n - 60_000, 60_000, 20_000]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + l for s, l, q in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    digest = lambda b: hashlib.sha256(b).hexdigest()
    some = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *some, digest("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()), digest(b" ".join(kept)))


def test_query_equals_brute_force(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows)
    small = [x for x in rows if x[1] is None or len(x[1]) < 9000]
    assert len(small) > 100 and sum(got[i][1] > 0 for i, _ in small) > 5
    for doc_id, text in small:
        assert got[doc_id][:8] == expected(doc_id, text)
    docs(spark, [(None, "a " * 40), (7, None), (20, "q r s t " * 30)]).write.parquet(f"{tmp_path}/documents.parquet")
    odd = {r.doc_id: r for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert (odd[None].n_runs, odd[None].start, odd[None].length, odd[None].period) == (1, 0, 40, 1)
    assert odd[7].n_runs == 0 and odd[7].start is None and odd[7].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert tuple(odd[20])[:8] == expected(20, "q r s t " * 30)
