import random

import pyarrow as pa
import pyarrow.parquet as pq

from halocline.llm import common, decontam
from halocline.llm.common import _ALNUM
from halocline.llm.decontam import build_index, clean_documents, decontaminate, matches, search_index

from .helpers import EXTRA, docs, some_texts


def words(t):
    return (t or "").encode().translate(_ALNUM).split()


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def brute(rows, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for win, its in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= its
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r))


def found(spark, rows, items, window):
    got = decontaminate(docs(spark, rows, EXTRA), item_table(spark, items), window).collect()
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r))


def test_random_texts(spark):
    items = list(enumerate(some_texts(7, 30, 15))) + [(100, None), (101, ""), (102, "river"), (103, "!!"), (104, "stone, LAMP"), (7, "cloud cloud")]
    rows = list(enumerate(some_texts(8, 60, 50))) + [(None, "a river"), (3, "stone lamp"), (3, "stone lamp"), (70, None), (71, "")]
    assert found(spark, rows, items, 4) == brute(rows, items, 4)
    assert found(spark, rows, items, 10) == brute(rows, items, 10)


def test_windows_in_blocks(spark, monkeypatch):
    items, rows = list(enumerate(some_texts(9, 20, 12))), list(enumerate(some_texts(10, 30, 40)))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 7)
    assert found(spark, rows, items, 3) == brute(rows, items, 3)


def test_blocks_judge_repeated_and_null_rows_each(spark, monkeypatch):
    items = list(enumerate(some_texts(9, 20, 12)))
    rows = list(enumerate(some_texts(10, 10, 40)))
    rows += rows[:4] + [(None, None), (None, None), (None, ""), (None, rows[1][1]), (None, rows[1][1]), (3, None), (3, None)]
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 7)
    assert found(spark, rows, items, 3) == brute(rows, items, 3)


def test_windows_do_not_span_documents(spark):
    rows = [(0, "one two three four five"), (1, "six seven eight nine ten")]
    assert all(r[2] == 0 for r in found(spark, rows, [(0, "one two three four five six seven eight nine ten")], 10))


def test_hot_passage_and_long_text(spark):
    p = "the same ten words stand in each of these documents"
    rows = [(i, f"{i} {p} {i}") for i in range(300)] + [(999, ("filler words " * 40_000) + p)]
    got = found(spark, rows, [(5, p)], 10)
    assert {(r[2], r[3]) for r in got} == {(10, "5")}


def test_one_index_answers_a_second_benchmark(spark):
    rows = list(enumerate(some_texts(11, 30, 40)))
    index = build_index(docs(spark, rows, EXTRA))
    for seed in (12, 13):
        items = list(enumerate(some_texts(seed, 20, 9)))
        got = {(r.doc_id, tuple(sorted(map(str, r["items"])))) for r in search_index(index, item_table(spark, items), 4).collect()}
        assert got == {(i, tuple(sorted(x for x in its.split(",") if x))) for i, _, _, its in brute(rows, items, 4)}
    # every word is posted
    posted = index.selectExpr("sum(size(positions)) n").first().n
    assert posted == sum(len(words(t)) for _, t in rows)


def test_proximity(spark):
    d = docs(spark, ["alpha x beta y gamma", "alpha x x x x x x beta gamma", "beta alpha gamma"])
    got = {r.doc_id: len(r.starts) for r in matches(d, item_table(spark, [(1, "alpha beta gamma")]), slop=4).collect()}
    assert got == {0: 1, 1: 0, 2: 1}


def test_cleaning_keeps_all_columns_and_empty_tables(spark):
    d = docs(spark, ["one two three", None, "other"], EXTRA)
    kept = clean_documents(d, item_table(spark, [(1, "two three")]))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert found(spark, [], [(1, "a b")], 10) == []
    assert found(spark, [(0, "a b")], [], 10) == [(0, 2, 0, "")]


def test_a_task_holds_few_segments_at_once(spark, monkeypatch):
    """Row groups of the index and batches of a search are bounded, however many segments a task has."""
    texts = [f"{i} " + " ".join(f"w{(i * k) % 997}" for k in range(2000)) for i in range(120)]
    rows, key = docs(spark, texts).coalesce(1), "spark.sql.execution.arrow.max{}PerBatch"
    before = {k: spark.conf.getAll.get(k) for k in (key.format("Records"), key.format("Bytes"))}
    spark.conf.set(key.format("Records"), "4")
    spark.conf.unset(key.format("Bytes"))
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 17)
    try:
        index = build_index(rows)
        groups = [pq.ParquetFile("/" + f.removeprefix("file:").lstrip("/")).metadata for f in index.inputFiles()]
        sizes = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
        assert sum(sizes) == 30 and max(sizes) <= decontam.GROUP_SEGMENTS
        seen = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows] * b.num_rows, pa.int32())], names=["n"]) for b in batches)
        spark.conf.set(key.format("Records"), "1000")
        assert max(r.n for r in index.coalesce(1).mapInArrow(seen, "n int").collect()) < 10
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
