"""Every registered query against its SQL, on whole tables."""

import os

import oracle
import pytest

from folio.plans import catalogue, oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    if name not in oracles.ORACLES:
        assert catalogue.QUERIES[name](spark, SF_DIR).count() > 0
        return
    n, difference = oracle.compare(spark, con, catalogue.QUERIES[name], oracles.ORACLES[name], SF_DIR)
    assert not difference
    assert n > 0


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(catalogue.QUERIES)
