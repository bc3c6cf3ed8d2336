"""Every registered query against its DuckDB oracle (sf0.001), and every
rows-only query at least runs."""

import pytest

from cartlake.queries import REGISTRY
from conftest import SF_SMALL
from oracle import compare, duck

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck(SF_SMALL)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(n for n, (_f, sql) in REGISTRY.items() if sql))
def test_matches_duckdb(spark, name):
    fn, sql = REGISTRY[name]
    ok, msg = compare(spark, fn, sql, SF_SMALL, _con())
    assert ok, msg


@pytest.mark.parametrize("name", sorted(n for n, (_f, sql) in REGISTRY.items() if not sql))
def test_rows_only_runs(spark, name):
    fn, _ = REGISTRY[name]
    df = fn(spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
