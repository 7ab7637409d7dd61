import random
from pathlib import Path

import pyarrow.parquet as pq

import corpus_pipeline
from halocline.llm.common import shared_dir, written
from halocline.llm.decontam import GROUP_SEGMENTS

from .helpers import EXTRA, SCHEMA, docs
from .test_decontam import brute as brute_decontam
from .test_line_dedup import brute as brute_lines
from .test_mixing import targets
from .test_simhash import classes, slow_fingerprint

LINE = "this boiler plate line stands in very many of the documents, number {}"
ITEM = "which of these twelve words make up one question of the test set"


def corpus(spark, folder):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randrange(3, 8)))
    vocabulary = [word() for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))]
        if i % 10 == 0:
            words[3:3] = ["vexmorish", "grolnaken", "drastys"]
        text = " ".join(words)
        if i % 10 == 1:
            text += "\n" + LINE.format(i % 3)
        if i % 10 == 2:
            text = f"{text}\n{ITEM}\n{text}"
        if i % 10 == 3 and i > 3:
            text = rows[3][1] if i % 20 == 3 else rows[3][1] + " "
        rows.append((i, text, ["web", "news", None][i % 3]))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(500, None, "web"), (501, "", "news"), (502, None, "web"), (503, "x " * 30_000, "web")]
    path = f"file://{folder}"
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "another item that no document of this corpus has in it")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, path


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, path = corpus(spark, tmp_path)
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        if name != "mix_sources":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in now.schema], name
        now = written(out, name)
        seen[name] = [(r.doc_id, r.text, r.source) for r in now.collect()]
        if name != "mix_sources":
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in now.collect()), name
    toxic = {i for i, _, _ in rows if i % 10 == 0 and i < 300}
    kept = [r for r in rows if r[0] not in toxic]
    assert sorted(r[0] for r in seen["toxicity"]) == sorted(r[0] for r in kept)
    texts = {i: t for i, _, _, t in brute_lines([r[:2] for r in kept])}
    assert {r[0]: r[1] for r in seen["line_dedup"]} == texts
    ids = sorted(texts)
    group = classes([slow_fingerprint(texts[i]) for i in ids], 2)
    firsts = {ids[g] for g in group}
    assert sorted(r[0] for r in seen["simhash_near_dedup"]) == sorted(firsts)
    hit = {r[0] for r in brute_decontam([(i, texts[i]) for i in firsts], [(1, ITEM)], 10) if r[2]}
    assert hit and sorted(r[0] for r in seen["benchmark_decontamination"]) == sorted(firsts - hit)
    source = {r[0]: r[2] for r in rows}
    sizes = {}
    for i in firsts - hit:
        sizes[source[i]] = sizes.get(source[i], 0) + len(texts[i].split())
    taken = {s: 0 for s in sizes}
    for r in now.collect():
        assert r.text == texts[r.doc_id] and 0 < r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)


def test_run_gives_what_the_stages_give(spark, tmp_path):
    _, path = corpus(spark, tmp_path)
    now = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, path), "stage")
    key = lambda df: sorted((r.doc_id, r.text, r.taken) for r in df.collect())
    assert key(corpus_pipeline.run(spark, path)) == key(now)


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    now = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, path), "stage")
    assert now.count() == 0


def test_repeated_and_null_ids_and_clashing_columns_against_brute_force(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e"), (None, "f g"), (None, "d e"), (2, None), (3, None), (1, "other words"), (3, "B"), (7, "A"), (7, "b"), (9, "d  e")]
    now = docs(spark, rows, EXTRA)
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, path), "stage")
        if name == "simhash_near_dedup":
            # one row of each set of equal words: the smallest id, null last
            best = {}
            for i, t in rows:
                words = " ".join((t or "").lower().split())
                best[words] = min(best.get(words, (True, 0)), (i is None, i or 0))
            assert sorted((r.doc_id is None, r.doc_id or 0, " ".join(r.text.lower().split())) for r in now.collect()) == sorted((n, i, w) for w, (n, i) in best.items())
    assert all(r.taken > 0 for r in now.collect())


def test_decontamination_reads_and_writes_its_index_in_small_row_groups(spark, tmp_path):
    """What a task holds of the index does not grow with the documents of a task."""
    path, key = f"file://{tmp_path}", "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    shared = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    had, before = set(shared.glob("postings-*")), spark.conf.getAll.get(key)
    spark.conf.set(key, "4")
    try:
        kept = corpus_pipeline.benchmark_decontamination(spark, docs(spark, [f"text {k}" for k in range(80)] + [ITEM]).coalesce(1), path)
        assert kept.count() == 80
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    (index,) = set(shared.glob("postings-*")) - had
    groups = [m.row_group(k).num_rows for m in (pq.ParquetFile(f).metadata for f in index.glob("*.parquet")) for k in range(m.num_row_groups)]
    assert sum(groups) == 21 and max(groups) <= GROUP_SEGMENTS
