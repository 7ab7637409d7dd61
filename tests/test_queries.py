"""Every registered query against its DuckDB form on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from halocline.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    """Rows as sorted tuples of comparable values, columns by name."""
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return ("", 0)
        if hasattr(x, "isoformat"):
            return (str(x)[:19].replace(" 00:00:00", ""), 0)
        if isinstance(x, str):
            return (x, 0)
        return ("#", round(float(x), 9))

    return list(df.columns), sorted(tuple(one(x) for x in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = plain(QUERIES[name](spark, sf).toPandas()), plain(duck.sql(ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"gbm_score"}))
def test_queries_without_sql_repeat_themselves(spark, sf, name):
    one, two = (plain(QUERIES[name](spark, sf).toPandas()) for _ in range(2))
    assert one == two and one[1]


def test_entry_keeps_working_without_the_text_operators(spark):
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["model", "d", "basin", "season", "n", "rmse", "mae", "bias", "r", "acc"]
