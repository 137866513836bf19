"""Session settings and the checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(name: str = "tidewatch", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the session comes from the submitter."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.sql.sources.fileCompressionFactor", FILE_TO_MEMORY)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


FILE_TO_MEMORY = "20"      # ids and names take up to so many times their bytes in Parquet once they are rows


def sized_by_rows(spark: SparkSession) -> None:
    """Lets Spark guess a table's size in memory, not in its compressed files.  Otherwise files below the broadcast threshold are sent
    through the driver whole, however many rows they hold; joins whose sides turn out to be small are still made broadcasts at run time."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_TO_MEMORY)


OPEN_COST = str(64 * 1024)     # bytes of a file that could be read in the time it takes to open one


def many_small_files(spark: SparkSession) -> None:
    """Lets a task read as many small files as it can read in large ones; by Spark's 4 MB for opening one it gets a few envelopes only."""
    spark.conf.set("spark.sql.files.openCostInBytes", OPEN_COST)


def checkpointed(df: DataFrame, *metrics: Column):
    """``df`` written once to the shared checkpoint folder and read back: lineage ends there, executor loss costs nothing,
    and readers still prune columns.  With ``metrics`` (aggregates) their values, taken during the write, come back too.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session gets one of its own."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    seen = Observation() if metrics else None
    (df.observe(seen, *metrics) if metrics else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._checkpoint = path
    return (out, seen.get) if metrics else out


def drop_checkpoint(df: DataFrame) -> None:
    """Deletes the table behind a frame made by ``checkpointed`` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._checkpoint)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    for _ in range(2):          # the first lets go of plans, the second of what only they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder (shared storage on a cluster)."""
    import uuid
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tidewatch-scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
