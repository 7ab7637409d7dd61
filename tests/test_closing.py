"""Append-mode streams: closed days, late rows, bounded state, restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from halocline.streaming.closing import DayLedger, new_ledger


def piece(spark, rows):
    return spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(hours=h) if h is not None else None, k, v) for h, k, v in rows], "ts timestamp, k string, v double")


def test_late_rows_are_kept_apart_and_days_are_written_once(spark, tmp_path):
    first = piece(spark, [(1, "a", 1.0), (2, "b", 2.0), (30, "a", 4.0), (24 * 6, "a", 8.0), (None, "a", 99.0)])
    ledger = new_ledger(spark, f"file://{tmp_path}", first.schema, ["k"], "v", "2 days")
    ledger.arrive(first)
    rows = lambda: sorted((str(r.day), r.k, r.n, r.s) for r in ledger.closed().collect())
    want = [("2024-01-01", "a", 1, 1.0), ("2024-01-01", "b", 1, 2.0), ("2024-01-02", "a", 1, 4.0)]
    assert rows() == want and ledger.late_rows().count() == 0
    # two rows of closed days, one of an open day, one that moves the watermark on
    late = piece(spark, [(3, "a", 16.0), (40, "c", None), (24 * 5, "b", 32.0), (24 * 30, "a", 64.0)])
    again = DayLedger(spark, ledger.root, first.schema, ["k"], "v", "2 days")  # another session's view of the same folder
    again.arrive(late)
    assert sorted(r.k for r in again.late_rows().collect()) == ["a", "c"] and {r.v for r in again.late_rows().collect()} == {16.0, None}
    assert rows() == sorted([*want, ("2024-01-06", "b", 1, 32.0), ("2024-01-07", "a", 1, 8.0)])
    query = again._sums_query()
    query.awaitTermination()
    again.run()
    assert len(rows()) == 5 and again.late_rows().count() == 2
    # every row with a time is closed, late or in an open day
    open_rows = 1
    assert again.closed().agg(F.sum("n")).first()[0] + again.late_rows().count() + open_rows == 8


def test_state_holds_open_days_alone(spark, tmp_path):
    e = piece(spark, [(h, "a", 1.0) for h in range(0, 24 * 40, 6)])
    ledger = new_ledger(spark, f"file://{tmp_path}", e.schema, ["k"], "v", "2 days")
    e.write.parquet(f"{ledger.root}/in")
    query = ledger._sums_query()
    query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    assert 1 <= state["numRowsTotal"] <= 3
    assert ledger.closed().count() == 40 - state["numRowsTotal"]
