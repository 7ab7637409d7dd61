import random

import xxhash
from pyspark.sql import functions as F

from halocline.llm.common import connected_components
from halocline.llm.simhash import fingerprint, near_duplicates, near_links

from .helpers import EXTRA, docs, some_texts


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def slow_fingerprint(text):
    w = lowered(text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, radius):
    """{index: smallest index reachable}."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    texts = some_texts(5, 60, 12)
    texts += [t + " extra" for t in texts[:20]] + [None, "", " \t", "one", "One two", "É é"]
    fps = [slow_fingerprint(t) for t in texts]
    assert [fingerprint((t or "").encode()) for t in texts] == fps
    want = classes(fps, 2)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs(spark, texts, EXTRA)).collect()}
    assert got == {i: (fps[i], want[i]) for i in range(len(texts))}


def linked(spark, fps, radius):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
    comp = {r.node: r.component for r in connected_components(links).collect()}
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(comp.get(f, f), []).append(i)
    return sorted(map(tuple, groups.values()))


def test_links_of_close_fingerprints(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    for radius in (1, 2, 3):
        want = {}
        for i, c in enumerate(classes(fps, radius)):
            want.setdefault(c, []).append(i)
        assert linked(spark, fps, radius) == sorted(map(tuple, want.values()))


def test_hot_group_null_ids_and_repeats(spark):
    rows = [(i, "the very same words again") for i in range(3, 500)] + [(None, "the very same words again"), (None, "alone"), (3, "the very same words again")]
    got = near_duplicates(docs(spark, rows)).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert sorted((r.component_id is None, r.component_id or 0, r.n) for r in got) == [(False, 3, 499), (True, 0, 1)]


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{k % 997}" for k in range(120_000))
    assert fingerprint(long.encode()) == slow_fingerprint(long)
    assert near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, k) for k in range(1001, 1500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path + star + [(5, 5), (None, 3)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1500)}
