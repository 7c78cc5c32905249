"""Every registered query of the library against its SQL on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quire.plans.flow_queries import QUERIES, SQL


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "nan", "None"):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, engine, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), engine.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
