"""Each query that SQL can express, held against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cellgrid.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind
        df[c] = df[c].map(lambda v: "null" if pd.isna(v) else v) if kind == "O" else df[c].astype(float).round(4).map(lambda v: "null" if v != v else repr(v + 0.0))
        df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    want, got = con.sql(ORACLE[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).toPandas()) > 0
