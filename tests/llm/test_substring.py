import random

import pytest

from halocline.llm.common import written
from halocline.llm.substring import FingerprintIndex, fingerprints, remove_repeats

from .helpers import EXTRA, docs, some_texts


def brute(rows, window):
    order = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < order(i) for p in range(s, s + window)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def found(spark, rows, window, gram, **options):
    got = remove_repeats(docs(spark, rows, EXTRA), window, gram, **options).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[3]))


@pytest.mark.parametrize("window,gram", [(6, 3), (10, 10), (5, 1)])
def test_random_texts(spark, window, gram):
    rows = list(enumerate(some_texts(window, 50, 40)))
    random.Random(3).shuffle(rows)
    assert found(spark, rows, window, gram) == brute(rows, window)


def test_production_window(spark):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(120)]
    rows = []
    for i in range(30):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(80))]
        a = rng.randrange(60)
        rows.append((i, " ".join(own + passage[a : a + rng.randrange(45, 60)] + own[:7])))
    rows += [(100, " ".join(passage)), (101, " ".join(passage)), (102, " ".join(passage) + " tail")]
    assert found(spark, rows, 50, 16) == brute(rows, 50)


def test_repeats_inside_one_document_stay(spark):
    rows = [(1, "a b c " * 20), (2, "x")]
    assert found(spark, rows, 5, 2) == brute(rows, 5)


def test_nulls_repeated_rows_and_short_texts(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (None, None), (1, t), (1, t), (1, "other words stand here now then"), (2, None), (3, ""), (4, "one two"), (5, "x " + t)]
    assert found(spark, rows, 5, 2) == brute(rows, 5)


def test_hot_passage_and_long_text(spark):
    p = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{p} d{i}") for i in range(300)] + [(1000, " ".join(f"v{k % 5000}" for k in range(60_000)) + " " + p)]
    assert found(spark, rows, 50, 16) == brute(rows, 50)


def test_incremental_index_and_empty_table(spark):
    from pyspark.sql import functions as F

    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    index = FingerprintIndex(spark, fanout=2)
    prints = [fingerprints(docs(spark, [(n, t)]).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), "text")) for n, t in enumerate([*texts, texts[0] + " more"])]
    for p in prints[:3]:
        index.add(p)
    assert index.shared().count() == 0
    assert index.unseen(prints[0]).count() == 0
    index.add(prints[3])
    assert index.shared().count() > 0
    index.runs.close()
    assert remove_repeats(docs(spark, [])).count() == 0


def test_a_later_session_continues_the_fingerprints(spark):
    from pyspark.sql import functions as F

    def of(session, rows):
        return fingerprints(docs(session, rows).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), "text"))

    texts = [(n, " ".join(f"{c}{k}" for k in range(60))) for n, c in enumerate("abca")]
    texts[3] = (3, texts[3][1] + " more")
    index, whole = FingerprintIndex(spark), FingerprintIndex(spark)
    index.add(of(spark, texts[:2]))
    path = index.runs.path
    index.runs.close()
    session = spark.newSession()
    later = FingerprintIndex(session, path=path)
    again = written(later.add(of(session, texts[2:])), "again")
    whole.add(of(spark, texts))
    want = {r.gram for r in whole.shared().collect()}
    assert want and {r.gram for r in later.shared(again).collect()} == want == {r.gram for r in later.shared().collect()}
    for x in (later, whole):
        x.runs.close()
