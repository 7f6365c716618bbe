"""Spark session settings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; they can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the next step needs the same partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # generated methods over 8000 bytes are never compiled by the JVM: split them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

# Sizes of tasks, for a session that has no others set. Spark's 64 MB of compressed shuffle are some 2 GB of sorted rows
# here (short rows, JSON texts that are folded and unfolded), and 200 partitions grow with the tables.
TASK_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "480",
    "spark.sql.files.maxPartitionBytes": "16m",
}


def small_tasks(spark: SparkSession) -> SparkSession:
    """Bound the rows of one task, whatever the size of the tables; settings the session already has are kept."""
    for key, value in TASK_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def keep_repeats_short(spark: SparkSession, dictionary_bytes: int = 64 << 20) -> None:
    """Let Parquet files hold a long text once for each row group, however many rows repeat it.

    A file's dictionary of values ends at 1 MB, and a text that no longer fits is written out in every row. A setting the
    session already has is kept. Values that seldom repeat are given up after the first page, as before.
    """
    if spark.conf.get("parquet.dictionary.page.size", None) is None:
        spark.conf.set("parquet.dictionary.page.size", str(dictionary_bytes))


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rollbook") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster use spark-submit and ``tune``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; on one machine, one below the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder, master = spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), spark.sparkContext.master
    if not re.match(r"local(\[|$)", master) and re.match(r"file:|/", folder):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    return f"{folder}/_shared"


def materialise(df: DataFrame) -> DataFrame:
    """A frame that several jobs read, computed once: checkpointed in the folder that spark.checkpoint.dir names.

    Without such a folder it is persisted, and recomputed where an executor is lost.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()
