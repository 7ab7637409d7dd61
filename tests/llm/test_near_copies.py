import random
from collections import Counter

import corpus_pipeline
from halocline.llm import near_copies as module
from halocline.llm.common import written
from halocline.llm.near_copies import near_copies

from .helpers import docs


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def planted(seed=1, groups=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(6))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([60, 100, 300]))]
        texts.append(base)
        for changes in (1, 2, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = word()
            texts.append(copy)
    return [" ".join(t) for t in texts]


def brute_components(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 9 >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(texts))]


def found(spark, texts, **options):
    rows = {r.doc_id: r.component for r in near_copies(docs(spark, texts), **options).collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    return [first[rows[i]] for i in range(len(texts))]


def test_recall_against_brute_force(spark):
    texts = planted() + ["a b c", "A  b\nc", "a b", None, "", " "]
    want = brute_components(texts)
    assert len(set(want)) < 0.7 * len(texts)
    assert found(spark, texts) == want


def test_large_buckets_are_decided_by_leaders_and_further_bands(spark, monkeypatch):
    monkeypatch.setattr(module, "PAIRED", 1)
    texts = planted(2, 12)
    assert found(spark, texts) == brute_components(texts)


def test_many_texts_somewhat_alike(spark):
    """A common passage makes 120 texts alike below the threshold; among them stand near copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(6))
    passage = [word() for _ in range(100)]
    texts = []
    for _ in range(120):
        own = [word() for _ in range(22)]
        texts.append(own + passage)
    for k in range(0, 120, 6):
        copy = list(texts[k])
        copy[3] = word()
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    want = brute_components(texts)
    assert len(set(want)) == 120 and found(spark, texts) == want
    assert found(spark, texts, exact=True) == want


def test_one_dense_group(spark):
    """300 edits of one text, alike by 0.6 to 1: recall of the links that brute force finds."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 6)):
            copy[at] = word()
        texts.append(" ".join(copy))
    want, got = brute_components(texts), found(spark, texts)
    # components may be split, never joined wrongly
    assert all(want[x] == want[g] for x, g in enumerate(got))
    biggest = lambda c: Counter(c).most_common(1)[0][1]
    assert biggest(want) > 100 and biggest(got) >= 0.95 * biggest(want)
    assert found(spark, texts, exact=True) == want


def test_stage_drops_copies_that_differ_by_a_word(spark):
    base = planted(3, 1)[0].split()
    texts = [" ".join(base), " ".join([*base[:20], "changed", *base[21:]])]
    left = written(corpus_pipeline.simhash_near_dedup(spark, docs(spark, texts), ""), "stage")
    assert [r.doc_id for r in left.collect()] == [0]


def test_stage_decides_by_row_where_ids_are_null_or_repeat(spark):
    a, b, c, d, e = (t for k, t in enumerate(planted(4, 5)) if k % 4 == 0)
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (3, d), (3, e), (4, a)]
    left = corpus_pipeline.simhash_near_dedup(spark, docs(spark, rows), "").collect()
    assert sorted(((r.doc_id or 0), r.text) for r in left) == sorted([(0, b), (1, c), (2, d), (3, e), (4, a)])
