"""Every registered query of the audit engine against its SQL."""

import glob
import os

import duckdb
import pytest

from folioscope.registry import oracles, queries

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return connection


def _rows(rows, names, order):
    return sorted(tuple((type(v).__name__ if not isinstance(v, float) else "f", round(v, 9) if isinstance(v, float) else str(v)) for v in (r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, TABLES)
    names = sorted(df.columns)
    got = _rows(df.collect(), names, names)
    found = duck.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == _rows(found.fetchall(), names, [columns.index(c) for c in names])
    assert got


def test_entry_without_the_optional_part(spark):
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
