"""Every query that has SQL gives the rows of that SQL."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from statuta.plans import queries

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def cell(v):
        return "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False, name=None))


def compare(spark, found, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.execute(sql).df(), found.toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got[sorted(got.columns)]) == rows(want[sorted(want.columns)])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    compare(spark, queries.QUERIES[name](spark, DATA), queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "rule", "n_docs", "n_hits"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
