"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare
from tests.conftest import DATA

# Long-running model fits have their own tests.
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    return compare.connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    result, rows, _ = compare.check(spark, duck, DATA, name)
    assert result == "same"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
