"""Registered queries beside their SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

SMALL = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# The smallest tables have three subjects per cohort, too few for a regression.
LARGER = os.environ.get("ORACLE_SCAN_DIR", "/root/testdata/sf0.01")
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    path = LARGER if QUERIES[name].__module__.endswith("queries_scan") else SMALL
    verdict = compare(spark, path, QUERIES[name], ORACLES[name])
    if verdict == "EMPTY result":  # filters can leave small tables without rows on both sides
        verdict = compare(spark, LARGER, QUERIES[name], ORACLES[name])
    assert verdict is None, verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    """Nothing that is registered fails, whether or not it has SQL."""
    assert QUERIES[name](spark, LARGER).limit(1).count() == 1


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
