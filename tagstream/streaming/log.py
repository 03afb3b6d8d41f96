"""An append-only decision log that a stream writes exactly once: a folder for each batch of each query, which a replay of the batch replaces by the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import exists, file_system


def append_once(path: str, query: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: rows of batch k go to query=<query>/batch=<k>. A batch that is whole there is not written again; one that was cut off is.

    query names the stream, over restarts: another stream to the same log has its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = f"{path}/query={query}/batch={number}"
        if not exists(batch.sparkSession, f"{own}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(own)

    return write


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of whole batches, with query and batch; none where nothing is written yet."""
    fs, path_of = file_system(spark, path)
    found = fs.globStatus(path_of(f"{path}/query=*/batch=*/_SUCCESS")) if exists(spark, path) else None
    whole = [str(s.getPath().getParent()) for s in found or []]
    full = f"{schema}, query string, batch long"
    return spark.read.schema(full).option("basePath", path).parquet(*whole) if whole else spark.createDataFrame([], full)
