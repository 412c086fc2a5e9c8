"""Every query against its SQL."""

from __future__ import annotations

import oracle
import pytest

from keyforge.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_agrees_with_sql(spark, con, name):
    assert oracle.compare(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE[name]) is None
