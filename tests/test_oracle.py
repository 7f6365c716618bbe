"""Every registered query of the catalog against its oracle SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
import check
from rollbook import catalog

from .conftest import DATA

@pytest.fixture(scope="module")
def duck():
    return check.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, duck, name):
    outcome = check.compare(spark, duck, DATA, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_registers_the_catalog():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["customer_id", "country", "customer_status", "system", "mrr_eur"]
