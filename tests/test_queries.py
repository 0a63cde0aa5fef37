"""Every query with SQL, on the smallest given data."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return {f: duck(f) for f in (SMALL, LARGER)}


def _own(name):
    """Queries of the optional subpackage have tests of their own."""
    return not (name.startswith("op") and name[2].isdigit()) and name != "pipeline"


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if _own(n)])
def test_query_matches_sql(spark, con, name):
    for folder in (SMALL, LARGER):  # the larger one where the small one gives no row
        problem, _, _ = compare(spark, con[folder], folder, entry.queries()[name], entry.oracle_sql()[name])
        if problem != "no rows":
            break
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
