"""Label audit: out-of-fold predictions by the nearest class centre (a stand-in for the classifier), disagreements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import adapter, frame

FOLDS, LEAST, SURE = 5, 0.0, 0.505

PREDICTED = """SELECT f.crop_id, f.fold, f.digit, c.digit AS pred, 1.0 / (1.0 + c.d) AS confidence FROM f JOIN (
  SELECT crop_id, digit, d, row_number() OVER (PARTITION BY crop_id ORDER BY round(d, 9), digit) AS rn FROM (
    SELECT f.crop_id, k.digit, sqrt(sum((f.v - k.v) * (f.v - k.v))) AS d FROM x f JOIN k ON k.fold = f.fold AND k.i = f.i GROUP BY f.crop_id, k.digit) q) c ON c.crop_id = f.crop_id AND c.rn = 1"""
MORE = {
    "f": lambda d: "SELECT crop_id, digit, crop_id % 5 AS fold, embedding FROM features",
    "x": lambda d: "SELECT crop_id, digit, fold, i, CAST(embedding[i] AS DOUBLE) AS v FROM f, generate_series(1, 64) t(i)",
    "s": lambda d: "SELECT digit, fold, i, sum(v) AS v, count(*) AS n FROM x GROUP BY digit, fold, i",
    "k": lambda d: "SELECT a.digit, t.fold, a.i, sum(a.v) / sum(a.n) AS v FROM s a JOIN generate_series(0, 4) t(fold) ON a.fold <> t.fold GROUP BY a.digit, t.fold, a.i",
    "p": lambda d: PREDICTED,
}


def out_of_fold(features: DataFrame, folds: int = FOLDS) -> DataFrame:
    """crop_id, fold, digit, pred, confidence: each row against class centres of the other folds' rows.

    Centres (classes x folds x dimensions) come from one aggregation of sums; a fold's own sums are left out.
    """
    f = features.select("crop_id", "digit", "embedding", F.pmod("crop_id", F.lit(folds)).alias("fold"))
    x = f.select("digit", "fold", F.posexplode("embedding").alias("i", "v")).groupBy("digit", "fold", "i").agg(F.sum(F.col("v").cast("double")).alias("v"), F.count("*").alias("n"))
    others = x.join(F.broadcast(features.sparkSession.range(folds).select(F.col("id").alias("to"))), F.col("fold") != F.col("to"))
    k = others.groupBy("digit", "to", "i").agg((F.sum("v") / F.sum("n")).alias("v")).groupBy("digit", "to").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    k = k.groupBy(F.col("to").alias("fold")).agg(F.array_sort(F.collect_list(F.struct("digit", F.col("c.v").alias("c")))).alias("centres"))
    dist = lambda c: F.sqrt(F.aggregate(F.zip_with("embedding", c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v))
    near = F.array_min(F.transform("centres", lambda z: F.struct(F.round(dist(z["c"]), 9).alias("d"), z["digit"].alias("digit"))))
    return f.join(F.broadcast(k), "fold").withColumn("near", near).select("crop_id", "fold", "digit", F.col("near.digit").alias("pred"), (1 / (1 + F.col("near.d"))).alias("confidence"))


@frame("oof_accuracy", "SELECT fold, count(*) AS n, round(avg(CASE WHEN pred = digit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY ROLLUP (fold)", ("features",), MORE)
def oof_accuracy(spark, sf_dir):
    p = out_of_fold(adapter(spark, sf_dir, "features"))
    return p.rollup("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("digit")).cast("double")), 6).alias("accuracy"))


def differing(found: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows whose prediction differs with a confidence of at least `least`, before it is rounded."""
    return found.where(F.col("pred") != F.col("digit")).where(F.col("confidence") >= least).select("crop_id", "digit", "pred", F.round("confidence", 4).alias("confidence"))


@frame("disagreements", "SELECT crop_id, digit, pred, round(confidence, 4) AS confidence FROM p WHERE pred <> digit", ("features",), MORE)
def disagreements(spark, sf_dir):
    return differing(out_of_fold(adapter(spark, sf_dir, "features")))


@frame("disagreements_sure", f"SELECT crop_id, digit, pred, round(confidence, 4) AS confidence FROM p WHERE pred <> digit AND confidence >= {SURE}", ("features",), MORE)
def disagreements_sure(spark, sf_dir):
    return differing(out_of_fold(adapter(spark, sf_dir, "features")), SURE)


@frame("top25", "SELECT crop_id, digit, pred, round(confidence, 4) AS confidence, CAST(row_number() OVER (ORDER BY round(confidence, 4) DESC, crop_id) AS INT) AS place FROM p WHERE pred <> digit ORDER BY place LIMIT 25", ("features",), MORE)
def top25(spark, sf_dir):
    top = disagreements(spark, sf_dir).orderBy(F.desc("confidence"), "crop_id").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("confidence"), "crop_id")))
