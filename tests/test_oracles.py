"""Every registered query against its DuckDB oracle (sf0.001 here; the driver uses sf0.01)."""

import pytest

import __spark_entry__ as entry
from alloy.plans import REGISTRY
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare, duck

QUERIES = {name: fn for name, fn in entry.queries().items() if name in REGISTRY}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_SMALL)
    assert r["status"] == "OK", r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["r_name", "c_mktsegment", "n_lines", "sum_qty", "revenue"]


@pytest.mark.parametrize("missing", ["corpus_pipeline", "alloy.llm.queries"])
def test_entry_without_the_training_data_operators(monkeypatch, missing):
    """Where that subpackage is not installed, its queries are absent and nothing else is."""
    import sys
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(entry.queries()) == set(entry.oracle_sql()) == set(REGISTRY)
