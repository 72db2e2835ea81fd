"""Every registered query against its DuckDB oracle on the smallest test tables."""
import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import digest
from hydroflow.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    r = con.execute(SQL[name])
    ocols = [d[0] for d in r.description]
    orows = r.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


# minutes each; test_keyed_trees.py runs the same functions with fewer trees
SLOW = {"algorithm_benchmark", "scored_predictions", "series_ablation"}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(SQL) - SLOW))
def test_query_without_oracle_runs(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.columns
    df.limit(1).collect()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "SoilMoisture" in df.columns
