"""Reports over label tables and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import adapter, frame
from .labels import LABELS, MA, accepted, labels

# A stand-in for a validation log: nine logits a row, five epochs of batches of 32, and angles, of which some are not valid.
STEPS = """SELECT crop_id % 5 AS epoch, crop_id // 160 AS batch, digit, CAST(digit AS INT) AS d, crop_id % 3 <> 0 AND crop_id % 5 <> 4 AS valid, (crop_id * 37) % 360 AS p, (crop_id * 53) % 360 AS t,
  list_transform(embedding[1:9], lambda v: CAST(v AS DOUBLE)) AS l FROM features WHERE digit <= '8'"""
ROWS = """SELECT epoch, batch, valid, ln(list_sum(list_transform(l, lambda v: exp(v - l[d + 1])))) AS loss, list_position(l, list_max(l)) - 1 = d AS hit,
  pow(sin(radians(p)) - sin(radians(t)), 2) + pow(cos(radians(p)) - cos(radians(t)), 2) AS sq, abs(((p - t + 180) % 360 + 360) % 360 - 180) AS err FROM steps"""
BATCHES = "SELECT epoch, batch, count(*) AS n, avg(loss) AS digit_loss, coalesce(sum(CASE WHEN valid THEN sq END) / count(CASE WHEN valid THEN 1 END), 0) AS rot_loss FROM rows GROUP BY epoch, batch"


@frame("epoch_metrics", """SELECT e.*, coalesce(digit_acc > max(digit_acc) OVER (ORDER BY e.epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM (
  SELECT b.epoch, round(b.digit_loss, 6) AS digit_loss, round(b.rot_loss, 6) AS rot_loss, round(r.acc, 6) AS digit_acc, round(r.mae, 6) AS rot_mae_deg FROM
    (SELECT epoch, sum(digit_loss * n) / sum(n) AS digit_loss, sum(rot_loss * n) / sum(n) AS rot_loss FROM batches GROUP BY epoch) b
    JOIN (SELECT epoch, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS acc, avg(CASE WHEN valid THEN CAST(err AS DOUBLE) END) AS mae FROM rows GROUP BY epoch) r ON r.epoch = b.epoch) e""", ("features",), {"steps": lambda d: STEPS, "rows": lambda d: ROWS, "batches": lambda d: BATCHES})  # fmt: skip
def epoch_metrics(spark, sf_dir):
    """The metrics log: means of batch means weighted by batch size, rotation only over valid rows (no angle error where there are none: null), and which epochs are better than all before."""
    f = adapter(spark, sf_dir, "features").where("digit <= '8'")
    d, k = F.col("digit").cast("int"), F.col("crop_id")
    rows = f.select((k % 5).alias("epoch"), F.floor(k / 160).alias("batch"), d.alias("d"), ((k % 3 != 0) & (k % 5 != 4)).alias("valid"), (k * 37 % 360).alias("p"), (k * 53 % 360).alias("t"), F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double")).alias("l"))
    return epochs(rows)


def epochs(rows: DataFrame) -> DataFrame:
    """From epoch, batch, d (class), valid, p and t (angles in degrees), l (logits)."""
    own = F.element_at("l", F.col("d") + 1)
    loss = F.log(F.aggregate("l", F.lit(0.0), lambda a, v: a + F.exp(v - own)))
    sq = F.pow(F.sin(F.radians("p")) - F.sin(F.radians("t")), 2) + F.pow(F.cos(F.radians("p")) - F.cos(F.radians("t")), 2)
    err = F.abs(F.pmod(F.col("p") - F.col("t") + 180, F.lit(360)) - 180).cast("double")
    hit = (F.array_position("l", F.array_max("l")) - 1 == F.col("d")).cast("double")
    per = rows.groupBy("epoch", "batch").agg(
        F.count("*").alias("n"), F.avg(loss).alias("digit_loss"), F.coalesce(F.sum(F.when(F.col("valid"), sq)) / F.nullif(F.count_if("valid"), F.lit(0)), F.lit(0.0)).alias("rot_loss"),
        F.sum(hit).alias("hits"), F.sum(F.when(F.col("valid"), err)).alias("err"), F.count_if("valid").alias("valid"),
    )
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(c)
    out = per.groupBy("epoch").agg(mean("digit_loss"), mean("rot_loss"), F.round(F.sum("hits") / F.sum("n"), 6).alias("digit_acc"), F.round(F.sum("err") / F.nullif(F.sum("valid"), F.lit(0)), 6).alias("rot_mae_deg"))
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # a row an epoch
    return out.withColumn("best", F.coalesce(F.col("digit_acc") > F.max("digit_acc").over(before), F.lit(True)))


@frame("label_report", """SELECT (SELECT count(*) FROM manual_log) AS manual_rows, (SELECT count(*) FROM manual_log WHERE digit = '') AS unreadable, (SELECT count(*) FROM auto_preds WHERE regexp_full_match(pred_text, '[0-9]') AND pred_text <> '0' AND score >= 0.75) AS auto_rows,
  (SELECT count(*) FROM m JOIN a ON a.crop_id = m.crop_id AND a.digit <> m.digit) AS overridden, (SELECT count(*) FROM labels) AS usable, (SELECT count(*) FROM labels WHERE digit = '9') AS out_of_scope""", MA, LABELS)  # fmt: skip
def label_report(spark, sf_dir):
    """One row: rows read, unreadable ones, crops on which the manual label differs and wins, usable labels and those out of scope."""
    manual, auto = adapter(spark, sf_dir, "manual_log"), accepted(adapter(spark, sf_dir, "auto_preds"))
    last = lambda t, v, at: t.groupBy("crop_id").agg(F.max_by(v, at).alias(v))
    both = last(manual.where("digit <> ''"), "digit", "log_pos").join(last(auto, "pred_text", "pos"), "crop_id").where("digit <> pred_text")
    usable = labels(spark, sf_dir)
    one = lambda t, name: t.agg(F.count("*").alias(name))
    out = manual.agg(F.count("*").alias("manual_rows"), F.count_if(F.col("digit") == "").alias("unreadable"))
    for t in (one(auto, "auto_rows"), one(both, "overridden"), usable.agg(F.count("*").alias("usable"), F.count_if(F.col("digit") == "9").alias("out_of_scope"))):
        out = out.crossJoin(t)  # a row each
    return out


@frame("digit_order", "SELECT digit, n, CAST(row_number() OVER (ORDER BY len(digit) > 1, digit) AS BIGINT) AS place FROM (SELECT CASE WHEN pred_text = 'O' THEN '10' ELSE pred_text END AS digit, count(*) AS n FROM auto_preds GROUP BY 1) t", ("auto_preds",))
def digit_order(spark, sf_dir):
    """Labels seen: single digits first, longer texts after them, each in the order of the text."""
    seen = adapter(spark, sf_dir, "auto_preds").select(F.when(F.col("pred_text") == "O", "10").otherwise(F.col("pred_text")).alias("digit")).groupBy("digit").agg(F.count("*").alias("n"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy(F.length("digit") > 1, "digit")).cast("long"))  # a row a label
