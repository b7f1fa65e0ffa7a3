"""Every registered query against its SQL; those without SQL have to return rows and have tests of their own."""

from __future__ import annotations

import pytest
from oracle import compare, duck

from tiltmeter.plans.registry import load_all

QUERIES = load_all()
BY_BRUTE_FORCE = {
    "histogram_range",
    "compared_methods",
    "proximal_zeros",
    "error_feedback",
    "error_feedback_by_label",
    "low_rank_keys",
    "progressive_rounding_by_label",
    "learned_clipping_by_label",
    "outlier_feedback",
    "static_windows",
}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, connection, name):
    assert compare(spark, name, QUERIES[name], sf_dir, connection) is None


def test_only_known_queries_lack_sql():
    assert {n for n, q in QUERIES.items() if q.sql is None} == BY_BRUTE_FORCE


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
