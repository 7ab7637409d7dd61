import pytest
from pyspark.sql import functions as F

from halocline.llm.mixing import mix_to_weights, mixed_documents

from .helpers import EXTRA, docs


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """sizes: {source: words}. Shares out the budget until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * per >= epochs * sizes[s]}
        if not full:
            return out | {s: w[s] * per for s in open_}
        for s in full:
            out[s] = epochs * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rows(spread):
    out, i = [], 0
    for s, sizes in spread.items():
        for n in sizes:
            out.append((i, "w " * n if n is not None else None, s))
            i += 1
    return out


@pytest.mark.parametrize("spread", [{"a": [3, 50, 7], "b": [100] * 5, "c": [10] * 30, "d": [1, 2, 3]}, {"z": [5], None: [9, None, 0], "é": [4], "Z": [0, None]}, {"one": [10, 20]}])
def test_targets_and_cuts(spark, spread):
    got = mix_to_weights(docs(spark, rows(spread), EXTRA)).collect()
    sizes = {s: sum(n or 0 for n in v) for s, v in spread.items()}
    want = targets(sizes)
    taken = {s: 0 for s in spread}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == sum(map(len, spread.values()))
    assert taken == {s: pytest.approx(t, abs=0.51) for s, t in want.items()}


def test_same_result_however_partitioned(spark):
    d = docs(spark, rows({"a": list(range(40)), "b": [7] * 60}))
    one, other = (sorted((r.doc_id, r.taken) for r in mix_to_weights(x).collect()) for x in (d.coalesce(1), d.repartition(7)))
    assert one == other


def test_repeated_rows_and_whole_documents(spark):
    d = docs(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d", "s"), (None, "e f", None), (3, None, "s")], EXTRA)
    out = mixed_documents(d)
    assert [c for c in out.columns if c not in ("size", "source_size", "target", "taken")] == [c for c in d.columns if c not in ("size", "taken")]
    assert out.where("taken <= 0").count() == 0 and out.groupBy().agg(F.count("*")).first()[0] <= 5


def test_repeated_rows_stay_within_the_target(spark):
    for extra in ([], [(9, "e f g", "s")], [(None, "h", None), (4, "", "s")]):
        d = docs(spark, [(1, "a b c d e f g h", "s"), (1, "a b c d e f g h", "s"), (2, "a", "t"), *extra], EXTRA)
        out = mixed_documents(d).collect()
        for source in {r.source for r in out}:
            rows = [r for r in out if r.source == source]
            assert rows[0].target - 2 <= sum(r.taken for r in rows) <= rows[0].target + 0.51


def test_whole_documents_take_what_the_figures_say(spark):
    d = docs(spark, rows({"a": list(range(40)), "b": [7] * 60, None: [3, None, 0]}), EXTRA)
    want = sorted((r.doc_id, r.taken) for r in mix_to_weights(d).collect() if r.taken)
    assert sorted((r.doc_id, r.taken) for r in mixed_documents(d).collect()) == want


def test_empty_table(spark):
    assert mix_to_weights(docs(spark, [])).count() == 0
    assert mix_to_weights(docs(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
