"""Registered queries beside their SQL at the smallest scale. ``tests/compare.py`` runs all of them."""

import pytest
from compare import compare, connect

SF = "/root/testdata/sf0.001"
# The two that run the whole job over all code are in ``tests/compare.py`` only: they take a minute each.
SLOW = ("corpus_analysis", "report_document")


def names():
    import __spark_entry__ as entry

    return sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n not in SLOW)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as entry

    assert compare(spark, con, name, SF, entry.queries(), entry.oracle_sql()) is None


def test_every_query_has_its_sql():
    from corpusmill.plans.oracles import ORACLES
    from corpusmill.plans.queries import QUERIES

    assert set(ORACLES) == set(QUERIES)
