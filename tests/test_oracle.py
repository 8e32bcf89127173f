"""Every registered query against independent SQL over the same whole tables."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from conftest import SMALL
from echotide.plans.catalog import catalog

ORACLE = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    assert difference(QUERIES[name](spark, SMALL), db, ORACLE[name]) is None


def test_every_review_query_has_sql():
    assert set(catalog()) <= set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
