"""Every registered query of the reference operators against its DuckDB SQL."""

import duckdb
import pandas as pd
import pytest

from engram.catalog import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v) + 0.0:.5f}"
        return str(v)[:26]

    names = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_oracle(name, spark, sf_dir, db):
    query, sql = QUERIES[name]
    got, want = query(spark, sf_dir).toPandas(), db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name][0](spark, sf_dir).count() > 0
