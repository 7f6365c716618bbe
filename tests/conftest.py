import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollbook.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def rows(spark):
    """Build a frame from tuples and a DDL schema."""

    def build(schema, *values):
        return spark.createDataFrame(list(values), schema)

    return build
