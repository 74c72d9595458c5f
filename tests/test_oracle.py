"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from salesledger.operators import skew
from verification.catalog import catalog
from verification.oracle import oracle_sql
from verification.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert catalog().keys() == oracle_sql().keys()
    assert catalog().keys() <= entry.queries().keys() and oracle_sql().keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", list(catalog()))
def test_query(spark, duck, name):
    same, note = compare(spark, duck, name, catalog()[name], oracle_sql()[name], SF_DIR)
    assert same, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["prepare_intermediate", "drop_refunded_transactions", "banana_ledger"])
def test_query_with_every_join_shuffled_and_salted(spark, duck, name, monkeypatch):
    """No broadcast chosen by size, no AQE, another time zone, and nearly every transaction counts as heavy."""
    other = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.session.timeZone": "America/New_York",
    }
    before = {key: spark.conf.get(key) for key in other}
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (2,))
    try:
        for key, value in other.items():
            spark.conf.set(key, value)
        same, note = compare(spark, duck, name, catalog()[name], oracle_sql()[name], SF_DIR)
        assert same, note
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
