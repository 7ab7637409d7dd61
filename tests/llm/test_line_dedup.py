import random
from collections import defaultdict

from halocline.llm.line_dedup import LineIndex, dedup_lines, long_lines

from .helpers import EXTRA, SPACES, docs

LONG = "a line that is certainly longer than forty characters, number {}"


def lowered(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_docs=5, min_chars=40):
    key = lambda line: lowered(line.strip(SPACES))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    order = lambda i: -(1 << 63) if i is None else i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= min_docs and order(i) < max(map(order, holders[key(x)])))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def same(spark, rows, **options):
    got = [tuple(r) for r in dedup_lines(docs(spark, rows, EXTRA), **options).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    plain = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[2]))
    assert plain(got) == plain(brute(rows, **options))


def test_random_texts(spark):
    rng = random.Random(1)
    lines = [LONG.format(k) for k in range(12)] + ["short", "", "É" * 39, "É" * 40, "ÉÄ" * 20]
    rows = []
    for i in range(60):
        own = [rng.choice(["", " ", "\t", "\x0b\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " ", "\r"]) for x in rng.choices(lines, k=rng.randrange(8))]
        rows.append((i, "\n".join(own)))
    same(spark, rows)
    same(spark, rows, min_docs=2, min_chars=1)


def test_nulls_repeats_and_long_texts(spark):
    hot = LONG.format("hot")
    rows = [(i, hot) for i in range(8)] + [(None, hot), (None, None), (3, hot), (3, None), (20, ""), (21, "\n" * 5), (22, (hot + "\n") * 30_000 + "end")]
    same(spark, rows)


def test_the_largest_id_keeps_all_its_copies(spark):
    hot = LONG.format("hot")
    got = {r.doc_id: (r.n_dropped, r.text) for r in dedup_lines(docs(spark, [(i, f"{hot}\n{hot}\nx{i}") for i in range(5)])).collect()}
    assert got[4] == (0, f"{hot}\n{hot}\nx4") and got[0] == (2, "x0")


def test_incremental_index(spark):
    hot = LONG.format("hot")
    index = LineIndex(spark, fanout=2)
    for batch in range(5):
        index.add(long_lines(docs(spark, [(batch, hot), (100 + batch, LONG.format(batch))])))
    assert [len(level) for level in index.runs.levels] == [1, 0, 1]
    assert [(r.n_docs, r.last_id) for r in index.repeated(5).collect()] == [(5, 4)]
    new = long_lines(docs(spark, [(200, hot), (201, LONG.format("unseen"))]))
    assert [r._id for r in index.unseen(new).collect()] == [201]
    index.runs.close()


def test_empty_table_and_no_python(spark):
    assert dedup_lines(docs(spark, [])).count() == 0
    assert "Python" not in dedup_lines(docs(spark, ["x"]))._jdf.queryExecution().toString()


def test_a_later_session_continues_the_index(spark):
    hot, other = LONG.format("hot"), LONG.format("other")
    rows = [(i, f"{hot}\n{other if i % 3 else 'x'}") for i in range(12)] + [(None, hot)]
    old, new = [r for r in rows if (r[0] or 0) < 6], [r for r in rows if (r[0] or 0) >= 6]
    index = LineIndex(spark, fanout=2)
    dedup_lines(docs(spark, old), index=index).count()
    path = index.runs.path
    index.runs.close()
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "3")  # other than when the runs were bucketed
    later = LineIndex(session, path=path)
    got = {(r.doc_id, r.text) for r in dedup_lines(docs(session, new), index=later).collect()}
    later.runs.close()
    assert got == {(r.doc_id, r.text) for r in dedup_lines(docs(spark, rows)).collect() if (r.doc_id or 0) >= 6}


def test_runs_are_neither_shuffled_nor_sorted(spark):
    index = LineIndex(spark)
    lines = long_lines(docs(spark, [(i, LONG.format(i % 7)) for i in range(20)]))
    index.add(lines)
    entries = lines.groupBy("h1", "h2").agg({"_id": "max"})
    plan = index.runs.unseen(entries)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    index.runs.close()
