"""Small helpers of the training-data operators: tables, cuts of lineage, joins with hot keys, bytes of Arrow columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import release as release
from tidewatch.session import scratch_path

HOT_KEYS = 1000        # at most so many keys are ever broadcast as hot
HOT_ROWS = 10_000      # keys with fewer rows are never hot
SLICES = 64            # a hot key is dealt over so many partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "llm", partition_by: str | None = None) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back, so that a lost executor costs no earlier step."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files behind a frame made by ``cut`` once nothing reads them any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_lookup(rows: DataFrame, by_key: DataFrame, keys: list[str], weight: str, deal: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to the smaller ``by_key``, which holds in ``weight`` the number of ``rows`` that its key will meet.

    The keys of most weight (at most HOT_KEYS, so the broadcast list is bounded) are dealt over SLICES partitions by ``deal``,
    a column that differs between rows of a key; every other key has at most a thousandth of all rows."""
    top = F.broadcast(by_key.where(F.col(weight) > HOT_ROWS).groupBy(*keys).agg(F.max(weight).alias("_w")).orderBy(F.desc("_w")).limit(HOT_KEYS)
                      .select(*keys, F.lit(True).alias("_hot")))
    left = (rows.join(top, keys, "left")
            .withColumn("_slice", F.when(F.col("_hot"), F.pmod(F.xxhash64(deal), F.lit(SLICES)).cast("int")).otherwise(F.lit(0))).drop("_hot"))
    right = (by_key.join(top, keys, "left")
             .withColumn("_slice", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0))))).drop("_hot"))
    return left.join(right, [*keys, "_slice"], how).drop("_slice")


def bytes_of(column: pa.Array) -> list[bytes]:
    """Values of a string or binary Arrow column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

