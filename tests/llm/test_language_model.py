import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from halocline.llm import elias_fano, language_model
from halocline.llm.elias_fano import EliasFano, build_trie, ef_encode, from_buffer, search_trie, to_bytes
from halocline.llm.language_model import STEP, score_documents

from .helpers import EXTRA, docs, some_texts


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def tokens(t):
    return [*lowered(t or "").encode().split(), None]


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7


def brute(rows, order=3):
    """Scores by dictionaries, in the same formulas."""
    train = [tokens(t) for i, t in rows if fold(i) != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter((a, b) for t in train for a, b in zip(t, t[1:]))
    total, v = sum(uni.values()), len(uni)
    tri = Counter(x for t in train for x in zip(t, t[1:], t[2:]))
    kept = Counter()
    for (a, b, _), n in tri.items():
        kept[a, b] += n * (n > 1)
    bins = lambda c: min(int(math.log2(max(c, 1))), 39)
    step = lambda p: round(-math.log10(p) * STEP) / STEP
    once3, all3 = Counter(), Counter()
    for (a, b), n in bi.items():
        if n > 1 and b is not None:
            once3[bins(n)] += n - kept[a, b]
            all3[bins(n)] += n
    back3 = lambda c: min(0.999, max(0.001, (once3[bins(c)] + 0.5) / (all3[bins(c)] + 1)))
    once, all_ = Counter(), Counter()
    for (a, _), n in bi.items():
        once[bins(uni[a])] += n == 1
        all_[bins(uni[a])] += n
    back = lambda c: min(0.999, max(0.001, (once[bins(c)] + 0.5) / (all_[bins(c)] + 1)))
    p1 = lambda w: (uni[w] + 1) / (total + v + 1)
    out = []
    for i, t in rows:
        ts = tokens(t)
        base = sum(math.log10(p1(w)) for w in ts)
        score = math.log10(p1(ts[0]))
        for k, (a, b) in enumerate(zip(ts, ts[1:])):
            new = back(uni[a])
            if uni[a] == 0:
                two = math.log10(p1(b))
            elif (a, b) in bi:
                two = -step((1 - new) * bi[a, b] / uni[a] + new * p1(b))
            else:
                two = math.log10(new * p1(b))
            before = (ts[k - 1], a) if k else None
            n = bi[before]
            if order > 2 and n > 1:
                lam = back3(n)
                beta = 1 - (1 - lam) * kept[before] / n
                third = tri[(*before, b)]
                two = -step((1 - lam) * third / n + beta * 10**two) if third > 1 else two - step(beta)
            score += two
        out.append((i, fold(i) == 2, len(ts), sum(uni[w] > 0 for w in ts), total, base, score))
    return out


def found(spark, rows):
    got = score_documents(docs(spark, rows, EXTRA)).collect()
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def same(got, want):
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-7) and g[6] == pytest.approx(w[6], abs=1.01 / STEP + 1e-7)


def test_scores_equal_brute_force(spark):
    rows = list(enumerate(some_texts(11, 80, 40)))
    rows += [(200, None), (201, ""), (202, "unseenword anotherone"), (None, "river river"), (3, "stone"), (3, "stone"), (204, "É é É")]
    same(found(spark, rows), brute(rows))
    two = score_documents(docs(spark, rows, EXTRA), order=2).collect()
    same(sorted((tuple(r) for r in two), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5])), brute(rows, 2))


def test_probabilities_after_a_bigram_add_up_to_one(spark):
    rng = random.Random(3)
    model = language_model.fit_model(docs(spark, [" ".join(rng.choice("abcd") for _ in range(12)) for _ in range(40)]))
    score = lambda t: model.score([t.encode()])["score"][0]
    for a, b in ("ab", "dc"):
        # P(a b w ...) over all w, each text's own end left out by comparing texts of one more word
        last = lambda w: token_score(model, f"{a} {b} {w}".strip(), 2)
        assert sum(10 ** last(w) for w in ("a", "b", "c", "d", "", "unseen")) == pytest.approx(1, abs=0.01)
        assert score(f"{a} {b}") < 0


def token_score(model, text, k):
    """log10 probability of the k-th token, as the difference that it makes; the end is the token after the last word."""
    ts = text.split()
    if k == len(ts):
        whole = model.score([text.encode()])["score"][0]
        return whole - prefix_score(model, ts)
    return prefix_score(model, ts[: k + 1]) - prefix_score(model, ts[:k])


def prefix_score(model, ts):
    """The score of the words without the end."""
    words = language_model.token_hashes([" ".join(ts).encode()])[0][:-1]
    real = language_model.token_hashes
    language_model.token_hashes = lambda texts: (words, np.array([len(words)]))
    try:
        return model.score([b""])["score"][0] if len(words) else 0.0
    finally:
        language_model.token_hashes = real


def test_many_small_shards_give_the_same(spark, monkeypatch):
    rows = list(enumerate(some_texts(12, 60, 40)))
    monkeypatch.setattr(language_model, "SHARD_WORDS", 4)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 50)
    monkeypatch.setattr(language_model, "HELD", 20)
    same(found(spark, rows), brute(rows))


def test_held_out_text_is_likelier_than_under_the_base(spark):
    rng = random.Random(13)
    cycle = [f"c{k}" for k in range(40)]
    rows = []
    for i in range(150):
        at = rng.randrange(40)
        rows.append((i, " ".join(cycle[(at + k) % 40] for k in range(rng.randrange(5, 50)))))
    got = [r for r in found(spark, rows) if r[1]]
    assert sum(r[6] for r in got) > 0.3 * sum(r[5] for r in got)


def test_empty_table_and_long_text(spark):
    assert score_documents(docs(spark, [])).count() == 0
    rows = [(0, " ".join(f"w{k % 3000}" for k in range(100_000))), (1, "w1 w2")]
    same(found(spark, rows), brute(rows))


@pytest.mark.parametrize("n,top", [(1, 0), (5, 4), (1000, 2000), (1000, 2**63), (3000, 3100)])
def test_elias_fano_access_and_search(n, top):
    rng = random.Random(n)
    values = np.array(sorted(rng.sample(range(top + 1), n)) if top < 10**6 else sorted({rng.randrange(top) for _ in range(n)}), np.uint64)
    arrays = from_buffer(np.frombuffer(to_bytes(ef_encode(values, "x")), np.uint8))
    ef = EliasFano(arrays, "x")
    assert (ef.access(np.arange(len(values))) == values).all()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), np.array([0, 7, top + 5], np.uint64)]))
    where = {int(v): k for k, v in enumerate(values)}
    assert ef.find(asked).tolist() == [where.get(int(x), -1) for x in asked]


def test_words_hash_as_they_compare(monkeypatch):
    texts = [t.encode() for t in [*some_texts(21, 60, 40), "É É é\x85x", "a" * 5000 + " a", ""]] + [None]
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 300)
    hashes, lengths = language_model.token_hashes(texts)
    words = [w for t in texts for w in [*tokens((t or b"").decode())]]
    assert lengths.tolist() == [len(tokens((t or b"").decode())) for t in texts] and len(hashes) == len(words)
    by_word, by_hash = {}, {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w


def test_trie(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(50), rng.randrange(60)) for _ in range(700)})
    keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
    trie = build_trie(keys, np.arange(len(keys), dtype=np.uint16), 60)
    where = {p: k for k, p in enumerate(pairs)}
    asked = [(a, b) for a in range(55) for b in range(60)]
    got = search_trie(trie, np.array([a << 32 | b for a, b in asked], np.uint64))
    assert got.tolist() == [where.get(p, -1) for p in asked]


def test_a_search_selects_once(monkeypatch):
    """The end of a bucket, and a pointer's successor, are the next bit after its beginning; results are those of a search."""
    rng = np.random.default_rng(5)
    calls = []
    select = elias_fano.select
    monkeypatch.setattr(elias_fano, "select", lambda *a: calls.append(1) or select(*a))
    for values in (rng.choice(10**6, 3000, False), np.uint64(2**63) + rng.choice(5000, 3000, False).astype(np.uint64), np.arange(700), np.array([0]), np.array([2**40]), np.concatenate([np.arange(300), 10**9 + np.arange(300)])):
        values = np.sort(values.astype(np.uint64))
        e = EliasFano(ef_encode(values, "v"), "v")
        asked = np.concatenate([values, values + np.uint64(1), np.arange(50, dtype=np.uint64)])
        calls.clear()
        got = e.find(asked)
        assert len(calls) == 1
        place = {int(v): k for k, v in enumerate(values)}
        assert got.tolist() == [place.get(int(v), -1) for v in asked]
        if len(values) > 1:
            calls.clear()
            one, two = e.access_two(np.arange(len(values) - 1))
            assert len(calls) == 1 and (one == values[:-1]).all() and (two == values[1:]).all()


def test_mapped_shards_are_plain_arrays(tmp_path):
    name = language_model._put(str(tmp_path), {"a": np.arange(5)})
    assert type(language_model._get(str(tmp_path), name)["a"]) is np.ndarray
