"""Every audit query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from pagelens.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def plain(frame):
    columns = sorted(frame.columns)
    value = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = [tuple(value(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLES:
        assert plain(got) == plain(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "page_url", "citability_score", "citation_probability"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
