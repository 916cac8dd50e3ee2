"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SMALL
from fallline.plans import oracles, registry

QUERIES = registry.REGISTRY
ORACLES = oracles.oracle_sql()
TABLES = ("region", "nation", "customer", "supplier", "events", "documents")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def _plain(row):
    return tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in row)


def _sorted(rows):
    return sorted((_plain(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = database.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    want = _sorted([r[i] for i in order] for r in result.fetchall())
    assert _sorted(df.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0

