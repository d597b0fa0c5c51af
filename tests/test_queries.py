"""Each registered query of the market package against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL, same

import __spark_entry__ as entry

QUERIES = {n: f for plan in entry.PLANS for n, f in plan.QUERIES.items()}
ORACLES = {n: q for plan in entry.PLANS for n, q in plan.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, duck, name):
    QUERIES[name](spark, SMALL).collect()


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
