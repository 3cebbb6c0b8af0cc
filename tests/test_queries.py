"""Every registered query against its SQL twin, or at least to completion."""

from __future__ import annotations

import pytest
from compare import check
from conftest import SMALL

from kpisleuth.plans import all_queries
from kpisleuth.plans.registry import compose

QUERIES = all_queries()


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_sql(spark, duck, name):
    problem, _ = check(spark, duck, SMALL, QUERIES[name].run, compose(QUERIES[name].sql))
    assert problem is None, problem


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_runs(spark, name):
    frame = QUERIES[name].run(spark, SMALL)
    assert frame.columns
    assert frame.count() >= 0


def test_entry_is_ranked(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and min(r["rank"] for r in rows) == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
