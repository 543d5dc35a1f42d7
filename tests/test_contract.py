"""Every core query with SQL against DuckDB over the same tables, where the driver's tables are at hand."""

from pathlib import Path

import pandas as pd
import pytest

from cuewright.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def views():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for f in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return connection


def plain(frame: pd.DataFrame) -> list[str]:
    null = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, float) else x
    return sorted(str(tuple(map(null, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, views, name):
    got, want = catalog.queries()[name](spark, str(FOLDER)).toPandas(), views.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
