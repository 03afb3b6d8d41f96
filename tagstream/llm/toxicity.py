"""Toxicity: character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

fit(): a bounded, documented sample of labelled documents (MAX_PER_CLASS of each class and MAX_BYTES of
text, lowest hashes of doc_id first) goes to the driver. Features are the character n-grams of a text's
lower-cased words, with word edges; each is scaled by its log-count ratio
log((p/|p|) / (q/|q|)), smoothed in proportion to the classes, and weighted by logistic regression. Only
n-grams whose ratio is LEAST_Z standard errors from 0 count: a long text has thousands of n-grams whose ratios
are chance, and their sum would hide a few telling ones. The model holds n-grams of the sample alone, so what
is broadcast is bounded whatever the input.
score(): a narrow map over whole texts.

Cases: null and empty texts get the score of the intercept; null labels and labels of unknown
documents are ignored, repeated ones count each time; without labels of both classes the score
is the smoothed share of label 1 for all rows; a null doc_id is not held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, documents, forget, map_rows, materialize, schema

MAX_PER_CLASS, MAX_BYTES, LONG_SHARE, MIN_DOCS = 1500, 16 << 20, 16, 2
N_MIN, N_MAX, LEAST_RATIO, LEAST_Z, SMOOTH, STEPS, L2 = 3, 8, 0.7, 2.5, 6.0, 150, 0.01
THRESHOLD = 0.7
_EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>*#$%&|-_/\\=+~`^@"
_BREAK = 10
_SIEVE_BITS = 20
#: fit() makes the n-grams in so many parts of their hashes, and looks at each in ranges, one after another, to bound the driver's memory.
_PART_BITS, _RANGE_BITS = 2, 4


def edges() -> np.ndarray:
    """For each code point below 128: itself, or the mark between words."""
    return np.array([_BREAK if chr(i) in _EDGES else i for i in range(128)], np.uint64)


def grams(text: str | None, table: np.ndarray) -> np.ndarray:
    """Hashes of the character n-grams inside the words of the lower-cased text, word edges included."""
    c = np.frombuffer(f"\n{text or ''}\n".lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    low = c < 128
    c[low] = table[c[low]]
    inner = c != _BREAK
    h, ok, out = np.full(len(c), N_MIN, np.uint64), np.ones(len(c), bool), []
    for n in range(1, min(N_MAX, len(c)) + 1):
        m = len(c) - n + 1
        h = (h[:m] ^ c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n > 2:
            ok = ok[:m] & inner[n - 2 : n - 2 + m]
        if n >= N_MIN:
            out.append(h[ok])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """text, toxic of at most max_per_class documents and max_bytes of whole texts a class; only the chosen ids are broadcast.

    Texts over a LONG_SHARE-th of max_bytes come last, the shortest of them first, so that none crowds out the others; a class of such texts alone keeps its shortest one, whatever its size.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rank = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    chosen = None
    for c in (0, 1):
        part = usable.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.groupBy(F.col("doc_id").alias("_id"), "toxic").agg(F.count("*").alias("times"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    sizes = materialize(rows.groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * F.col("times")).alias("size"), F.first("times").alias("times")), "sample")
    long = F.when(F.col("size") > max_bytes / LONG_SHARE, F.col("size")).otherwise(0)
    order = Window.partitionBy("toxic").orderBy(long, rank, "doc_id")  # max_per_class rows each
    sizes = sizes.withColumn("upto", F.sum("size").over(order)).withColumn("place", F.row_number().over(order))
    ids = sizes.where((F.col("upto") <= max_bytes) | (F.col("place") == 1)).select(F.col("doc_id").alias("_id"), "toxic", "times")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return rows.select("text", "toxic", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("text", "toxic")


def fit(rows: list[tuple[str | None, int]]) -> dict:
    """keys: sorted hashes of n-grams, their weights, bias. rows: (text, 0 or 1)."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    base = math.log((n1 + 1) / (n0 + 1))
    if not n0 or not n1:
        return {"keys": np.empty(0, np.uint64), "weights": np.empty(0), "bias": base}
    table = edges()
    y = np.array([y for _, y in rows], float)
    s1, s0 = SMOOTH * n1 / (n0 + n1), SMOOTH * n0 / (n0 + n1)
    found, total = [], 0
    for part in range(1 << _PART_BITS):
        docs = []
        for text, _ in rows:
            h = grams(text, table)
            docs.append(np.unique(h[h >> np.uint64(64 - _PART_BITS) == part]))
        for k in range(part << _RANGE_BITS - _PART_BITS, part + 1 << _RANGE_BITS - _PART_BITS):
            own = [d[d >> np.uint64(64 - _RANGE_BITS) == k] for d in docs]
            keys, flat = np.unique(np.concatenate(own), return_inverse=True)
            row = np.repeat(np.arange(len(docs)), [len(d) for d in own])
            p = np.bincount(flat, weights=y[row], minlength=len(keys))
            df = np.bincount(flat, minlength=len(keys))
            q = df - p
            ratio = np.log((p + s1) / (n1 + s1)) - np.log((q + s0) / (n0 + s0))
            use = (df >= MIN_DOCS) & (np.abs(ratio) >= np.maximum(LEAST_RATIO, LEAST_Z * np.sqrt(1 / (p + s1) + 1 / (q + s0))))
            place = np.cumsum(use) - 1 + total
            on = use[flat]
            found.append((keys[use], ratio[use], place[flat[on]], row[on]))
            total += int(use.sum())
    keys, r, col, row = (np.concatenate(x) for x in zip(*found, strict=True))
    w, b = np.zeros(len(keys)), 0.0
    weight = 1 / len(y)
    grad2, bias2 = np.full(len(keys), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(row, weights=(w * r)[col], minlength=len(rows)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(col, weights=err[row], minlength=len(keys)) * r + L2 * w / len(y)
        grad2 += g * g
        bias2 += err.sum() ** 2
        w -= 0.1 * g / np.sqrt(grad2)
        b -= 0.1 * err.sum() / math.sqrt(bias2)
    return {"keys": keys, "weights": w * r, "bias": float(b)}


def scorer(model: dict):
    """text -> score. The sieve drops most n-grams without a weight before the search in the sorted keys."""
    keys, weights, bias, table = model["keys"], model["weights"], model["bias"], edges()
    shift = np.uint64(64 - _SIEVE_BITS)
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[keys >> shift] = True

    def score(text: str | None) -> float:
        z = bias
        if len(keys):
            h = grams(text, table)
            h = np.unique(h[sieve[h >> shift]])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            z += float(weights[at[keys[at] == h]].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def score_toxicity(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value)
        return lambda c: [c[0], [score(t) for t in c[1]]]

    return map_rows(df.select(key, text), make, schema(f"{key} {kind}, score double"))


def train(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit([(r.text, r.toxic) for r in training_sample(docs, labels).toLocalIterator()])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, train(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents predicted toxic; all columns stay. The model is fitted on the documents of sf_dir."""
    model = train(spark, documents(spark, sf_dir), sf_dir)
    shared = spark.sparkContext.broadcast(model)
    bounded(spark)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget("packing")
        f = scorer(shared.value)
        for texts in batches:
            yield pd.Series([f(t) for t in texts], dtype=float)

    return docs.where(score(F.col("text")) < THRESHOLD)
