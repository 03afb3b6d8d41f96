"""The folder that all executors share, and ranks over whole tables without one task for all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on a local master (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext._jsc.sc()
    if not found and sc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tagstream-"))
    return (found or sc.getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


#: Spark's own setting: the shuffle files of a query go when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(path: str, *parts: DataFrame) -> DataFrame:
    """These tables, one after the other, written to path and read back. What a part has shuffled goes when it is written; the table goes with the session."""
    spark = parts[0].sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        for part in parts:
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(parts[0].schema).parquet(path)


def kept(df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
    """df (and more tables like it) as a table in the shared folder: compressed, where a checkpoint is not."""
    return written(f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df, *more)


def numbered(df: DataFrame, name: str, *order, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """df with its rows numbered from 1 in this total order: ranges are sorted apart, and each adds the rows of those before. keep writes the sorted rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at_")))
    sizes = sorted(map(tuple, rows.groupBy("part_").count().collect()))  # a row a range
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "part_ int, before_ long")
    return rows.join(F.broadcast(offsets), "part_").withColumn(name, F.col("before_") + F.col("at_") + 1).drop("part_", "at_", "before_")
