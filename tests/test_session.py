"""Task sizes of the registered queries."""

from rollbook import session
from rollbook.catalog import QUERIES

from .conftest import DATA


def test_queries_bound_the_rows_of_a_task(spark):
    """The first query sets the sizes; what a session has set itself stays."""
    before = {key: spark.conf.get(key, None) for key in session.TASK_CONF}
    try:
        for key in before:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3m")
        QUERIES["q_scan_region"](spark, DATA)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "3m"
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
        assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > 200
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
