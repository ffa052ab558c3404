"""Every registered query against its DuckDB twin, on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from groundwork.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if v is None or isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "quantize") else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(value(r[i]) for i in at) for r in found.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "tag" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
