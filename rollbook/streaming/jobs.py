"""Job counts over an event folder that is read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import BUSINESS_ZONE


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of the folder, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_job_counts(events: DataFrame, mapping: dict[str, str], lateness: str = "1 day") -> DataFrame:
    """The job counts of the batch job as a streaming aggregate.

    Events repeated within ``lateness`` are counted once. The local day is the window, so its state can be
    dropped once the watermark has passed it.
    """
    kind = F.col("event_type")
    job = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[kind]
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), BUSINESS_ZONE)
    rows = events.filter(kind.isin(list(mapping))).select("event_id", "user_id", "event_type", job.alias("job_type"), local.alias("local_ts"))
    deduplicated = rows.withWatermark("local_ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    counts = deduplicated.groupBy(F.window("local_ts", "1 day").alias("w"), "user_id", "event_type", "job_type").agg(F.count(F.lit(1)).alias("jobs"))
    return counts.select(F.col("w.start").cast("date").alias("job_date"), "user_id", "event_type", "job_type", "jobs")


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to a Parquet folder, process what is there, and stop."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
