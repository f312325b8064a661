"""Value oracle: every registered query with SQL against DuckDB (sf0.001)."""

import os

import pytest

from tests.conftest import SF_SMALL

SLOW = {"x2_char_tfidf"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names():
    import __spark_entry__ as E

    return sorted(k for k in E.oracle_sql() if k not in SLOW)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", _names())
def test_matches_duckdb(spark, duck, name):
    import __spark_entry__ as E
    from tools.check_oracle import rows_of

    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, cur.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["period_end", "sell", "rolling_3", "rolling_6"]


def test_every_query_has_an_entry():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
