import math
import random
import re

import numpy as np
import pytest

from halocline.llm.toxicity import fit_ordinal, fit_toxicity, keep_clean, score_toxicity

from .helpers import EXTRA, WORDS, docs

BAD = ["vexmor", "grolnak", "drasty"]


def corpus(n=240, seed=1):
    """Every third document holds bad words, inflected; (texts, labels)."""
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if k % 3 == 0:
            for _ in range(rng.randrange(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "en", "isch"]))
        texts.append(" ".join(words))
        labels.append((k, 1 - k % 2, int(k % 3 == 0)))  # two grades; graded() has three
    return texts, labels


def graded(texts):
    """Severity as annotators might give it: 2 from three bad words on."""
    bad = [sum(w.startswith(tuple(BAD)) for w in t.split()) for t in texts]
    return [(k, 0 if not n else 1 if n < 3 else 2) for k, n in enumerate(bad)]


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    texts, labels = corpus(600)
    got = score_toxicity(docs(spark, texts, EXTRA), label_table(spark, labels[:400])).collect()
    assert len(got) == len(texts)
    assert all(r.toxic == (r.doc_id % 3 == 0) for r in got if r.doc_id >= 400)
    assert all(0 <= r.severity <= 1 and r.grade in (0, 1) and r.severity == r.p_toxic for r in got)


def test_three_grades(spark):
    texts, _ = corpus(600)
    grades = spark.createDataFrame(graded(texts)[:400], "doc_id long, severity int")
    got = score_toxicity(docs(spark, texts, EXTRA), grades).collect()
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) and 0 <= r.p_toxic <= 1 for r in got)
    want = dict(graded(texts))
    mean = {g: np.mean([r.severity for r in got if r.doc_id >= 400 and want[r.doc_id] == g]) for g in (0, 1, 2)}
    assert mean[0] < 0.3 < 0.8 < mean[1] < 1.3 < 1.6 < mean[2]
    assert np.mean([r.grade == want[r.doc_id] for r in got if r.doc_id >= 400]) > 0.9


def brute(texts, grades, asked):
    """p_toxic of the asked texts by plain counting, over a dense matrix."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    names = lambda w: ["w" + w] + [f"p{w[:n]}" for n in range(3, 9) if len(w) > n]
    holders = [{f for w in words(t) for f in names(w)} for t in texts]
    n = [sum(1 for g in grades if (g > 0) == x) for x in (False, True)]
    found = []
    for f in set().union(*holders):
        clean, bad = (sum(f in h for h, g in zip(holders, grades) if (g > 0) == x) for x in (False, True))
        ratio = ((bad + 0.5) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))
        if bad >= max(5, 0.005 * n[1]) and ratio >= 8:
            found.append(f)

    def row(t):
        own = [f for w in words(t) for f in names(w)]
        return [math.log1p(own.count(f)) for f in found] + [math.log1p(len(words(t))) / 10]

    x = np.array([row(t) for t in texts])
    rows, cols = np.indices(x.shape)
    w, theta = fit_ordinal(rows.ravel(), cols.ravel(), x.ravel(), np.array(grades), x.shape[1])
    return [1 / (1 + math.exp(theta[0] - np.dot(row(t), w))) for t in asked]


@pytest.mark.parametrize("three", [False, True])
def test_against_brute_force(spark, three):
    texts, labels = corpus(150, 5)
    texts[7:9] = [None, ""]
    grades = graded([t or "" for t in texts]) if three else [(k, t) for k, _, t in labels]
    table = spark.createDataFrame(grades[:100], f"doc_id long, {'severity' if three else 'toxic'} int")
    got = {r.doc_id: r.p_toxic for r in score_toxicity(docs(spark, texts, EXTRA), table).collect()}
    want = brute(texts[:100], [g for _, g in grades[:100]], texts)
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, abs=1e-6)


def test_long_clean_texts_stay_clean(spark):
    rng = random.Random(8)
    texts, labels = corpus(300)
    # one clean document in three holds a bad word's beginning in another word, long ones more often
    long = [" ".join(rng.choice([*WORDS, "drastic"]) for _ in range(5000)) for _ in range(40)]
    rows = [*enumerate(texts), *[(1000 + k, t) for k, t in enumerate(long)]]
    table = label_table(spark, [*labels, *[(1000 + k, 1, 0) for k in range(20)]])
    got = {r.doc_id: r.toxic for r in score_toxicity(docs(spark, rows), table).collect()}
    assert not any(got[1000 + k] for k in range(40))
    assert all(got[k] == (k % 3 == 0) for k in range(300))


def test_severity_rises_with_more_bad_words(spark):
    texts, labels = corpus()
    more = [(1000 + n, "river stone " + "vexmor grolnak " * n) for n in (0, 1, 4)]
    got = {r.doc_id: r.severity for r in score_toxicity(docs(spark, [*enumerate(texts), *more]), label_table(spark, labels)).collect()}
    assert got[1000] < got[1001] < got[1004]


def test_nulls_repeats_and_long_texts(spark):
    texts, labels = corpus(90)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "filler " * 100_000 + "vexmor grolnak drasty vexmors"), (None, "vexmor grolnak vexmor drasty"), (0, texts[0])]
    odd = [*labels, (None, 1, 1), (900, None, None), (1, 1, 0), (1, None, None)]
    got = {(r.doc_id, r.toxic) for r in score_toxicity(docs(spark, rows), label_table(spark, odd)).collect()}
    assert {(900, False), (901, False), (902, True), (None, True)} <= got
    kept = keep_clean(docs(spark, rows, EXTRA), label_table(spark, odd))
    assert kept.columns == docs(spark, [], EXTRA).columns
    assert {902, None} & {r.doc_id for r in kept.collect()} == set()


def test_without_labels_nothing_is_toxic(spark):
    d = docs(spark, ["vexmor", None])
    assert [r.toxic for r in score_toxicity(d, label_table(spark, [])).collect()] == [False, False]
    assert keep_clean(d, label_table(spark, [(0, 1, 0)])).count() == 2
    assert score_toxicity(docs(spark, []), label_table(spark, [(0, 1, 1)])).count() == 0


def test_the_labelled_sample_is_bounded(spark):
    texts, labels = corpus(90)
    model = fit_toxicity(docs(spark, texts), label_table(spark, labels), max_labelled=30, max_features=3)
    assert len(model.features) <= 3


def nll(w, theta, x, y):
    s = 1 / (1 + np.exp(-(theta[None, :] - (x @ w)[:, None])))
    s = np.column_stack([np.zeros(len(y)), s, np.ones(len(y))])
    return -np.log(s[np.arange(len(y)), y + 1] - s[np.arange(len(y)), y]).mean()


def test_ordinal_fit_is_at_a_minimum_with_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = np.digitize(x @ np.array([1.0, -2.0, 0.5]) + rng.logistic(size=2000), [-1.0, 1.5])
    rows, cols = np.nonzero(np.ones_like(x))
    w, theta = fit_ordinal(rows, cols, x.ravel(), y, 3, penalty=1e-6, steps=1500)
    assert w == pytest.approx([1.0, -2.0, 0.5], abs=0.15) and theta == pytest.approx([-1.0, 1.5], abs=0.15)
    best = nll(w, theta, x, y)
    for k in range(3):
        for d in (-0.05, 0.05):
            assert nll(w + d * np.eye(3)[k], theta, x, y) > best
    assert theta[0] < theta[1]
