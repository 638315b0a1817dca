"""Every registered query against its SQL on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry
from shelfwise.plans import load_all, registry

SF_DIR = entry.SMOKE_DIR
load_all()
QUERIES = {name: fn for name, fn in entry.queries().items() if name in registry.QUERIES}
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    status, _, _, note = check.compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "rows"), note


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
