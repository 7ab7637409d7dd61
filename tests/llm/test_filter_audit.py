import itertools
import random

import pytest

from halocline.llm.filter_audit import Limits, audit_filters, block_hashes, judged_texts, refined, repeated_texts
from halocline.llm.common import written

from .helpers import EXTRA, docs, some_texts

LABELS = "doc_id long, quality int, toxic int, part string"


def failed(rows):
    """The filters' letters that each (doc_id, text) fails, straight from their statement."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        w = text.encode().split()
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text)}
        bad["E"] = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t in rows)
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    """rows: (doc_id, text, lang). Every order is applied step by step."""
    fails = failed([r[:2] for r in rows])
    said = {}
    for i, q, t in labels:
        was = said.get(i, (False, False))
        said[i] = (was[0] or q == 1, was[1] or t == 1)
    out, shapley = {}, {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, said.get(r[0], (False, False)) if r[0] is not None else (False, False)) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                redundant = sum(k in x[0] for x in own) - len(gone)
                out[part, "".join(order), step + 1] = (len(left), len(gone), redundant, sum(x[0] == {k} for x in own), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone))
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def rows_of(seed):
    rng = random.Random(seed)
    texts = [t + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]) for t in some_texts(seed, 30, 160)]
    texts += [f"{k} " + " ".join(f"w{i}{seed}" for i in range(120)) for k in (1, 1, 2)] + ["é" * 64 + "a", "é" * 64 + "b", "é" * 64 + "a", "e" * 65, None, "", None]
    rows = [(rng.choice([None, k, k, k, k // 3]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(120)]
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    return rows, labels


def frame(spark, rows, schema=EXTRA):
    n = len(schema.split(", ")) - 5
    return spark.createDataFrame([(i, t, lang, "s", None, *[None] * n) for i, t, lang in rows], schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_equals_brute_force(spark, seed):
    rows, labels = rows_of(seed)
    got = audit_filters(frame(spark, rows), spark.createDataFrame([(*x, "x") for x in labels], LABELS))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_repeated_texts_and_what_refinement_leaves(spark):
    long = "word " * 20_000
    rows = [(k, t, "en") for k, t in enumerate([long + "a", long + "b", long + "a", "x" + long + "a", "short", "shorT", "short", "", None, *["copy"] * 300])]
    d = frame(spark, rows)
    judged = written(judged_texts(d), "judged")
    left = {r.doc_id for r in refined(judged).collect()}
    assert left == {0, 2, 4, 6, 7, 8, *range(9, 309)}
    assert {r.doc_id for r in repeated_texts(d, judged).collect()} == {2, 6, 8, *range(10, 309)}


def test_blocks_cover_the_text():
    assert block_hashes(b"") == [] and len(block_hashes(b"a" * 64)) == 1 and len(block_hashes(b"a" * 65)) == 2
    text = bytes(random.Random(3).randrange(256) for _ in range(5000))
    for k in range(0, 5000, 7):
        assert block_hashes(text) != block_hashes(text[:k] + bytes([text[k] ^ 1]) + text[k + 1 :])


def test_limits_and_empty_tables(spark):
    d, labels = frame(spark, [(1, "a b", None)]), spark.createDataFrame([], LABELS)
    got = audit_filters(d, labels, Limits(words=2)).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and all(r.kept == 1 and r.removed == r.shapley == 0 for r in got)
    assert audit_filters(frame(spark, []), labels).count() == 0
