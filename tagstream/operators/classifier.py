"""The crop classifier on Spark: scoring in Arrow batches, and training by gradients that are summed in a tree, one model a fold.

A model's size is fixed by its architecture (1.2 MB as it is), so that weights are broadcast and summed gradients come to the
driver whatever the number of crops. Training rows are dealt once, by hash, to batches of about BATCH crops, written as a row each; a step
reads its share of the batches, each task sums its gradients for every model, and these are added up FAN_IN at a time.
Reruns over the same written batches give the same weights.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network as net
from ..functions.pixels import prepared

#: Crops of a training batch (each takes some 15 MB while its gradient is made), crops that are scored at once, sums that are added up at once.
BATCH, SCORED, FAN_IN = 32, 16, 32
#: Rows of an Arrow batch while batches of crops are read: a row is half a megabyte.
ROWS = 8
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SUMS = "model int, task int, crops long, digit_loss double, turn_loss double, sums binary"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    before = spark.conf.get(RECORDS)
    spark.conf.set(RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(RECORDS, before)


def save_weights(spark: SparkSession, w: net.Weights, path: str) -> None:
    out = io.BytesIO()
    np.savez(out, **w)
    spark.createDataFrame([(out.getvalue(),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> net.Weights:
    with np.load(io.BytesIO(spark.read.parquet(path).first()[0])) as found:
        return {n: found[n] for n in found.files}


def images_of(x: list[bytes]) -> np.ndarray:
    size = int(round((len(x[0]) / 3) ** 0.5))
    return np.frombuffer(b"".join(x), np.uint8).reshape(len(x), size, size, 3)


def score(images: DataFrame, w: net.Weights, key: str = "crop_id", size: int = net.SIZE) -> DataFrame:
    """key, digit, confidence, angle of every image; nulls where it can't be decoded. A worker holds one copy of the weights."""
    return scored(prepared(images, size, key).withColumn("fold", F.lit(0)), [w], key).drop("model")


def scored(rows: DataFrame, models: list[net.Weights], key: str) -> DataFrame:
    """From key, x, fold (the number of the model): key, digit, confidence, angle, model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    out = pa.schema([("key", pa.int64()), ("digit", pa.int32()), ("confidence", pa.float64()), ("angle", pa.float64()), ("model", pa.int32())])

    def run(batches):
        for batch in batches:
            x, fold = batch["x"].to_pylist(), batch["fold"].to_numpy(zero_copy_only=False)
            found: list[tuple] = [(None, None, None)] * len(x)
            for f in np.unique(fold):
                at = [i for i in np.flatnonzero(fold == f).tolist() if x[i] is not None]
                for k in range(0, len(at), SCORED):
                    part = at[k : k + SCORED]
                    for i, r in zip(part, zip(*(c.tolist() for c in net.classify(shared.value[int(f)], images_of([x[i] for i in part]))), strict=True), strict=True):
                        found[i] = r
            yield pa.record_batch([batch["key"].cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), list(out)[1:4], strict=True)), batch["fold"].cast(pa.int32())], schema=out) if x else pa.record_batch([pa.array([], t.type) for t in out], schema=out)

    kinds = "key long, digit int, confidence double, angle double, model int"
    return rows.select(F.col(key).alias("key"), "x", F.col("fold").cast("int").alias("fold")).mapInArrow(run, kinds).withColumnRenamed("key", key)


def write_batches(rows: DataFrame, path: str, seed: int = 42, per_batch: int = BATCH, key: str = "crop_id") -> DataFrame:
    """From key, x, digit (int), angle (degrees), valid (whether the angle counts), fold: the written batches, a row each. Rows without an image go."""
    rows = rows.where("x is not null").select(F.col(key).alias("key"), "x", "digit", F.radians("angle").alias("angle"), "valid", F.col("fold").cast("int").alias("fold"))
    n = max(1, -(-rows.count() // per_batch))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n)))
    one = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("key", "x", "digit", "angle", "valid", "fold"))).alias("rows"))  # about per_batch rows, by hash
    one.repartition(max(1, n // ROWS), "batch").sortWithinPartitions("batch").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def class_weights(batches: DataFrame, held_out: list[int | None], classes: int) -> list[np.ndarray]:
    """For each model: all its rows / (classes * rows of the class); a class without rows counts as one row."""
    counts = batches.select(F.explode("rows").alias("r")).groupBy("r.fold", "r.digit").count().collect()  # folds x classes
    out = []
    for f in held_out:
        n = np.zeros(classes)
        for r in counts:
            if f is None or r.fold != f:
                n[r.digit] += r["count"]
        n = np.maximum(n, 1)
        out.append(n.sum() / (classes * n))
    return out


def packed(g: net.Weights, names: list[str]) -> bytes:
    return np.concatenate([g[n].astype(np.float64).ravel() for n in names]).tobytes()


def unpacked(raw: bytes, like: net.Weights) -> net.Weights:
    flat, out, at = np.frombuffer(raw), {}, 0
    for n, v in like.items():
        out[n] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def gradients(batches: DataFrame, models: list[net.Weights], held_out: list[int | None], weights: list[np.ndarray], seed: int, epoch: int) -> list[tuple[int, float, float, net.Weights] | None]:
    """For each model: crops, losses and mean gradient over the batches' rows that it may see."""
    shared = batches.sparkSession.sparkContext.broadcast((models, weights))

    def run(parts):
        models, weights = shared.value
        names = list(models[0])
        sums: dict[int, list] = {}
        for part in parts:
            for number, rows in zip(part["batch"].to_pylist(), part["rows"].to_pylist(), strict=True):
                angle = np.array([r["angle"] or 0.0 for r in rows])
                b = net.Batch(images_of([r["x"] for r in rows]), np.array([r["digit"] for r in rows]), np.stack([np.sin(angle), np.cos(angle)], 1), np.array([bool(r["valid"]) and r["angle"] is not None for r in rows], float))
                tone, fold = np.random.default_rng([seed, epoch, number]).uniform(0.85, 1.15, len(rows)).astype(np.float32), np.array([-1 if r["fold"] is None else r["fold"] for r in rows])
                for m, f in enumerate(held_out):
                    on = fold >= -1 if f is None else fold != f
                    n = int(on.sum())
                    if n < 2:  # no statistics of a single crop
                        continue
                    g, digit, turn = net.step(models[m], b.take(on), weights[m], tone[on])
                    own = sums.setdefault(m, [0, 0.0, 0.0, np.zeros(sum(v.size for v in models[m].values()))])
                    own[0], own[1], own[2] = own[0] + n, own[1] + n * digit, own[2] + n * turn
                    own[3] += n * np.frombuffer(packed(g, names))
        task = TaskContext.get().partitionId()
        for m, (n, digit, turn, total) in sums.items():
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([digit]), pa.array([turn]), pa.array([total.tobytes()], pa.binary())], names=[x.split()[0] for x in SUMS.split(", ")])

    def add(key, table):
        t = table.sort_by("task")
        total = sum(np.frombuffer(x) for x in t["sums"].to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([sum(t[c].to_pylist())], t.schema.field(c).type) for c in ("crops", "digit_loss", "turn_loss")), pa.array([total.tobytes()], pa.binary())], names=t.column_names)

    found, tasks = batches.mapInArrow(run, SUMS), batches.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = found.groupBy("model", F.floor(F.col("task") / FAN_IN).cast("int").alias("upper")).applyInArrow(add, SUMS)
    out: list = [None] * len(models)
    for r in found.collect():  # a row a model
        out[r.model] = (r.crops, r.digit_loss / r.crops, r.turn_loss / r.crops, {n: v / r.crops for n, v in unpacked(r.sums, models[r.model]).items()})
    return out


class Adam:
    def __init__(self, w: net.Weights, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({n: np.zeros(w[n].shape) for n in net.learnt(w)} for _ in range(2))

    def move(self, w: net.Weights, g: net.Weights) -> net.Weights:
        self.t += 1
        out = {}
        for n, x in w.items():
            if n not in self.m:  # running statistics
                out[n] = ((1 - net.MOMENTUM) * x + net.MOMENTUM * g[n]).astype(np.float32)
                continue
            self.m[n], self.v[n] = 0.9 * self.m[n] + 0.1 * g[n], 0.999 * self.v[n] + 0.001 * g[n] ** 2
            out[n] = (x - self.rate * self.m[n] / (1 - 0.9**self.t) / (np.sqrt(self.v[n] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
        return out


def evaluated(rows: DataFrame, models: list[net.Weights], held_out: list[int | None], key: str = "crop_id") -> dict[int, tuple[float, float | None]]:
    """For each model: the share of its held-out fold's rows (all rows, where it has none) whose digit it finds, and the mean error of the angles that count, in degrees."""
    of = F.array(*(F.lit(k) for k, f in enumerate(held_out) if f is None), *(F.when(F.col("fold") == f, k) for k, f in enumerate(held_out) if f is not None))
    own = rows.where("x is not null").withColumn("fold", F.explode(F.array_compact(of)))
    found = scored(own, models, key).select(F.col(key).alias("found_key"), F.col("digit").alias("found"), F.col("angle").alias("found_angle"), "model")
    both = own.join(found, (F.col(key) == F.col("found_key")) & (F.col("fold") == F.col("model")))
    off = F.abs(F.pmod(F.col("found_angle") - F.col("angle") + 180, F.lit(360)) - 180)
    sums = both.groupBy("model").agg(F.avg((F.col("found") == F.col("digit")).cast("double")).alias("right"), F.avg(F.when(F.col("valid"), off)).alias("off"))
    return {r.model: (r.right, r.off) for r in sums.collect()}


def train(
    batches: DataFrame, held_out: list[int | None], epochs: int = 25, steps: int = 1, rate: float = 1e-3, seed: int = 42, channels: tuple[int, ...] = net.CHANNELS, classes: int = net.CLASSES, check: DataFrame | None = None,
) -> tuple[list[net.Weights], list[tuple]]:
    """A model for each entry of held_out, of all rows but that fold's (None: of all rows), and (epoch, model, digit loss, direction loss) of each epoch.
    An epoch takes `steps` steps, each over the batches that fall to it by hash. With rows to check against (as evaluated() takes them), each
    model is the one after its best epoch, the first of equals, and the log's entries go on with the share of digits found and the angles' error."""
    spark = batches.sparkSession
    weights = class_weights(batches, held_out, classes)
    models = [net.initial(seed + (f or 0), channels, classes) for f in held_out]
    movers = [Adam(w, rate) for w in models]
    log, best = [], [(-1.0, w) for w in models]
    with arrow_rows(spark, ROWS):
        for epoch in range(epochs):
            seen = np.zeros((len(models), 3))
            for k in range(steps):
                own = batches.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "batch"), F.lit(steps)) == k)
                for m, found in enumerate(gradients(own, models, held_out, weights, seed, epoch)):
                    if found:
                        n, digit, turn, g = found
                        seen[m] += n, n * digit, n * turn
                        models[m] = movers[m].move(models[m], g)
            now = [(epoch, m, *(s[1:] / max(1, s[0])).tolist()) for m, s in enumerate(seen)]
            if check is not None:
                found = evaluated(check, models, held_out)
                now = [(*entry, *found.get(m, (0.0, None))) for m, entry in enumerate(now)]
                best = [(entry[4], w) if entry[4] > b[0] else b for entry, w, b in zip(now, models, best, strict=True)]
            log += now
    return models if check is None else [w for _, w in best], log


def out_of_fold(rows: DataFrame, models: list[net.Weights], key: str = "crop_id") -> DataFrame:
    """key, digit, confidence, angle of each row with a fold, by the model that did not see this fold."""
    return scored(rows.where(F.col("fold") >= 0), models, key).drop("model")
