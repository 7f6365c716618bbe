"""The queries that SQL can state, against DuckDB."""

import pytest

import check
from rollbook.llm import catalog

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, name):
    outcome = check.compare(spark, check.connect(DATA), DATA, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14)) and set(catalog.ORACLES) <= set(catalog.QUERIES)
