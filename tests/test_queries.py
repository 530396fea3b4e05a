"""Every registered query against its SQL oracle at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from siftwork.plans import oracle, registry

from .compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_an_oracle():
    assert set(registry.registered()) - registry.WITHOUT_SQL == set(oracle.oracles())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 9
