"""Shared helpers: the folder that all executors see, written tables, Arrow row maps."""

from __future__ import annotations

import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import shared_dir

#: Rows and bytes of text that a Python worker holds as objects at once.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

#: Rows and bytes of a batch on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

#: A word: a run of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def bounded(spark: SparkSession) -> None:
    """Set the session's batches to BATCH_ROWS rows and BATCH_BYTES at most, so that what is on its way to Python workers stays small."""
    if int(spark.conf.get(_ROWS)) > BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
        spark.conf.set(_BYTES, BATCH_BYTES)


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are materialized inside go to a folder of their own, which is deleted at the end."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(path)
    try:
        yield
    finally:
        _scratch.pop()
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession) -> str:
    """The innermost scratch, or the shared folder."""
    return _scratch[-1] if _scratch else shared_dir(spark)


def passing(spark: SparkSession, path: str) -> str:
    """path, which the driver deletes when its session ends, if nothing has before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder (the innermost scratch) and read it back: cuts lineage, survives lost executors. The table goes with the session."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (in any case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(df: DataFrame):
    """All columns of df in one struct, so that their names cannot clash with others."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def staged(spark: SparkSession, stage, docs: DataFrame, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """A stage's rows, written, and their folder; what it wrote on the way is deleted."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        passing(spark, path)
    return spark.read.schema(out.schema).parquet(path), path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch):
    """Cut a batch so that few rows and bytes become Python objects at once."""
    start, n = 0, batch.num_rows
    while start < n:
        rows = min(SLICE_ROWS, n - start)
        while rows > 1 and _bytes(batch, start, rows) > SLICE_BYTES:
            rows //= 2
        yield batch.slice(start, rows)
        start += rows


def _bytes(batch: pa.RecordBatch, start: int, rows: int) -> int:
    return sum(c.slice(start, rows).nbytes for c in batch.columns)


def map_rows(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """mapInArrow over df. make() runs once per task and returns f(columns) -> list of columns, or a generator of such lists, which then are batches of their own."""
    out = to_arrow_schema(schema)
    bounded(df.sparkSession)

    def run(batches):
        forget("packing")
        f = make()
        for batch in batches:
            for part in slices(batch):
                got = f([c.to_pylist() for c in part.columns])
                for cols in (got,) if isinstance(got, (list, tuple)) else got:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def map_beside(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """Like map_rows, for the columns after df's first, which goes beside the results without becoming Python objects."""
    first = df.schema.fields[0]
    whole = T.StructType([first, *schema.fields])
    out = to_arrow_schema(whole)
    bounded(df.sparkSession)

    def run(batches):
        forget("packing")
        f = make()
        for batch in batches:
            for part in slices(batch):
                cols = f([c.to_pylist() for c in part.columns[1:]])
                yield pa.record_batch([part.column(0).cast(out.field(0).type), *(pa.array(c, t.type) for c, t in zip(cols, list(out)[1:], strict=True))], schema=out)

    return df.mapInArrow(run, whole)


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def worker_state(kind: str, version: str) -> dict:
    """A dict that a Python worker keeps from task to task, one of each kind; a new version starts it anew."""
    import sys
    import types

    kept = sys.modules.setdefault("_tagstream_worker", types.ModuleType("_tagstream_worker")).__dict__
    if kept.get(kind, ("", {}))[0] != version:
        kept[kind] = (version, {})
    return kept[kind][1]


def trim() -> None:
    """Give what earlier tasks of this worker have freed back to the system: workers are used again, and allocators keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def forget(kind: str) -> None:
    """Give up what a worker keeps of a kind: the caches of one operator are no use to the next."""
    import sys

    kept = sys.modules.get("_tagstream_worker")
    if kept is not None:
        kept.__dict__.pop(kind, None)
    trim()


#: Keys that joined_first broadcasts: those with more than one of FREQUENT rows. There are fewer of them, whatever the table.
FREQUENT = 200_000


def joined_first(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows left-joined with found (key once; a column `rows` with its rows, which is dropped), whatever a key's share of the rows:
    keys with most rows are broadcast, the others joined, so that no task gets more than a share of 1 / FREQUENT in one key."""
    total = found.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    if total[1] <= FREQUENT:
        return rows.join(F.broadcast(found.drop("rows")), key, "left")
    hot = F.col("rows") * FREQUENT > total[0]
    often = found.where(hot).select(key, F.lit(True).alias("often_"), *(F.col(c).alias(f"{c}_") for c in found.columns if c not in (key, "rows")))
    marked = rows.join(F.broadcast(often), key, "left")
    names = [c for c in found.columns if c not in (key, "rows")]
    first = marked.where("often_").select(*rows.columns, *(F.col(f"{c}_").alias(c) for c in names))
    rest = marked.where("often_ is null").select(*rows.columns).join(found.where(~hot).drop("rows"), key, "left")
    return first.unionByName(rest.select(*rows.columns, *names))


_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SKETCH_BLOCK, FAN_IN = 1 << 12, 32


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ _U(salt)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def powers(state: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(state.get("up", ())) < n:
        n = max(n, 1 << 15, 2 * len(state.get("up", ())))
        state["up"], state["down"] = (np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(b))]), dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return state["up"], state["down"]


def word_hashes(text: str, state: dict) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    raw, start, end = word_bounds(text.encode("utf-8", "surrogatepass").lower())
    return span_hashes(raw, start, end, state)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes between two spaces, start and end of each word in them."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    return raw, edge[0::2], edge[1::2]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, state: dict) -> np.ndarray:
    """A 64-bit hash of raw[start:end] of each span; raw may hold bytes or hashes."""
    if not len(start):
        return np.empty(0, _U)
    up, down = powers(state, len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start], 0) ^ mix((end - start).astype(_U), 77)


def squeezed(counts: np.ndarray) -> bytes:
    """Most counts of a task are small: a few bits each."""
    return zlib.compress(counts.tobytes(), 1)


def count_sketch(df: DataFrame, bits: int, make) -> np.ndarray:
    """Counts of the hashes that make()(columns) yields as arrays, in 2^bits places by their leading bits. Tasks
    add up their own; blocks of places are then added up by FAN_IN at a time, so no group grows with the input."""
    rows = schema("task int, block int, counts binary")
    out = to_arrow_schema(rows)
    step = min(SKETCH_BLOCK, 1 << bits)
    bounded(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        forget("packing")
        f, total = make(), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch):
                for h in f([c.to_pylist() for c in part.columns]):
                    np.add.at(total, (h >> _U(64 - bits)).astype(np.int64), np.uint32(1))
        task = TaskContext.get().partitionId()
        for b in range(0, len(total), step):
            if total[b : b + step].any():
                yield pa.record_batch([pa.array([task], pa.int32()), pa.array([b // step], pa.int32()), pa.array([squeezed(total[b : b + step])], pa.binary())], schema=out)

    def add(key, table):
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in table["counts"].to_pylist())
        return pa.table([pa.array([key[1].as_py()], pa.int32()), pa.array([key[0].as_py()], pa.int32()), pa.array([squeezed(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))], pa.binary())], schema=out)

    parts = materialize(df.mapInArrow(run, rows), "sketch")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy("block", F.floor(F.col("task") / FAN_IN).cast("int").alias("upper")).applyInArrow(add, rows)
    total = np.zeros(1 << bits, np.uint32)
    for r in parts.select("block", "counts").collect():  # 2^bits places
        total[r.block * step : (r.block + 1) * step] = np.frombuffer(zlib.decompress(r.counts), np.uint32)
    return total
