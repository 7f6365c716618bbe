"""Files, export, streaming, and what the plans must and must not contain."""

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollbook.operators import keyed
from rollbook.plans import usage
from rollbook.session import materialise
from rollbook.sources import incremental_slice, load, load_csv
from rollbook.streaming.jobs import read_events, stream_job_counts, write_counts

from .conftest import DATA

JOBS = {"view": "routes", "purchase": "exports"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_with_semicolons(spark):
    path = tempfile.mkdtemp(prefix="rollbook-csv-") + "/t.csv"
    with open(path, "w") as out:
        out.write("id;since;ok\n1;2024-01-02;True\n2;;\n")
    rows = load_csv(spark, path, "id int, since date, ok boolean", sep=";").orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2] and rows[0]["ok"] is True and rows[1]["since"] is None


def test_slice_and_columns_reach_the_scan(spark):
    plan = plan_of(incremental_slice(load(spark, DATA, "events"), "event_id", 5, 9).select("event_id"))
    assert "GreaterThanOrEqual(event_id,5)" in plan and "ReadSchema: struct<event_id:bigint>" in plan


def test_latest_row_is_limited_before_the_shuffle(spark):
    df = keyed.latest_per_key(load(spark, DATA, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")])
    assert "WindowGroupLimit" in plan_of(df)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in {"q_logistic", "q_cross_validate"}])
def test_no_unbounded_nested_loop(spark, name):
    """Nested-loop joins occur only against one-row aggregates."""
    plan = plan_of(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in plan
    if name in {"q_odometer", "q_odometer_audit", "q_active_stats", "q_interval_join", "q_asof_reading", "q_date_spine"}:
        assert "BroadcastNestedLoopJoin" not in plan


def test_stream_equals_batch(spark):
    schema = load(spark, DATA, "events").schema
    folder = tempfile.mkdtemp(prefix="rollbook-events-")
    events = load(spark, DATA, "events")
    events.repartition(3).write.mode("overwrite").parquet(folder)
    counts = stream_job_counts(read_events(spark, folder, schema), JOBS, lateness="60 days")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("job_counts").trigger(availableNow=True).start()
    query.awaitTermination()
    pick = ["user_id", "job_date", "job_type", "jobs"]
    got = sorted(tuple(r) for r in spark.table("job_counts").select(*pick).collect())
    assert got == sorted(tuple(r) for r in usage.job_counts(events, JOBS).select(*pick).collect())


def test_closed_days_are_appended(spark):
    events = load(spark, DATA, "events")
    folder, work = tempfile.mkdtemp(prefix="rollbook-events-"), tempfile.mkdtemp(prefix="rollbook-out-")
    events.orderBy("ts").coalesce(1).write.mode("append").parquet(folder)
    query = write_counts(stream_job_counts(read_events(spark, folder, events.schema), JOBS), work + "/counts", work + "/checkpoint")
    query.awaitTermination()
    got = spark.read.parquet(work + "/counts")
    closed = got.agg(F.max("job_date")).first()[0]
    pick = ["user_id", "job_date", "job_type", "jobs"]
    want = usage.job_counts(events, JOBS).filter(F.col("job_date") <= F.lit(closed)).select(*pick)
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, want.collect()))


def test_a_frame_is_kept_without_a_local_folder(spark):
    """Without a checkpoint folder the frame is persisted; with one it is written there and its lineage is cut."""
    kept = materialise(spark.range(10).selectExpr("id * 2 AS id"))
    assert kept.count() == 10 and (kept.is_cached or spark.sparkContext.getCheckpointDir())
    kept.unpersist()
