"""Every registered query on the small tables; those with SQL against DuckDB, as sorted rows of columns in name order."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from komagrid import plans

ORACLES = plans.oracle_sql()


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "quantize"):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def duck(folder):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, folder, duck, name):
    df = plans.queries()[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        expected = rows_of(columns, result.fetchall())
        assert len(got) == len(expected)
        assert [(a, b) for a, b in zip(got, expected, strict=True) if a != b][:3] == []
    else:
        assert isinstance(got, list)


def test_entry(spark, folder):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
