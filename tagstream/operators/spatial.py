"""Spatial joins inside a frame, annotation roll-ups and order-dependent folds over boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.dialect import adapter, frame, relational
from ..plans.shared import numbered

BOX = ("x1", "y1", "x2", "y2")


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select("video", "frame", *(F.col(c).alias(f"{p}{c}") for c in ("det_idx", *BOX, "conf")))


def match_tags(d: DataFrame) -> DataFrame:
    """For each animal: the first tag whose centre lies inside, else that of the highest overlap above 0. One equi-join on the frame."""
    a, t = prefixed(d.where("cls = 0"), "a_"), prefixed(d.where("cls = 1"), "t_")
    pairs = a.join(t, ["video", "frame"]).withColumn("inside", g.inside(g.center("t_x1", "t_x2"), g.center("t_y1", "t_y2"), "a_")).withColumn("iou", g.iou("a_", "t_"))
    w = Window.partitionBy("video", "frame", "a_det_idx").orderBy(F.desc("inside"), F.when(F.col("inside"), F.col("t_det_idx")), F.desc("iou"), "t_det_idx")
    return pairs.where("inside OR iou > 0").withColumn("rn", F.row_number().over(w)).where("rn = 1")


IOU = """(greatest(least(a.x2, t.x2) - greatest(a.x1, t.x1), 0) * greatest(least(a.y2, t.y2) - greatest(a.y1, t.y1), 0))"""


@frame("tag_to_animal", f"""SELECT video, frame, animal, tag, inside, iou FROM (SELECT *, row_number() OVER (PARTITION BY video, frame, animal ORDER BY inside DESC, CASE WHEN inside THEN tag END, iou DESC, tag) AS rn
  FROM (SELECT a.video, a.frame, a.det_idx AS animal, t.det_idx AS tag, (t.x1 + t.x2) / 2 BETWEEN a.x1 AND a.x2 AND (t.y1 + t.y2) / 2 BETWEEN a.y1 AND a.y2 AS inside,
    {IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - {IOU}) AS iou
    FROM detections a JOIN detections t ON a.video = t.video AND a.frame = t.frame AND a.cls = 0 AND t.cls = 1) p WHERE inside OR iou > 0) q WHERE rn = 1""", ("detections",))  # fmt: skip
def tag_to_animal(spark, sf_dir):
    return match_tags(adapter(spark, sf_dir, "detections")).select("video", "frame", F.col("a_det_idx").alias("animal"), F.col("t_det_idx").alias("tag"), "inside", "iou")


def container_sql(d):
    return """SELECT video, frame, tag, animal, x1, y1, x2, y2, conf FROM (SELECT t.video, t.frame, t.det_idx AS tag, a.det_idx AS animal, t.x1, t.y1, t.x2, t.y2, t.conf,
      row_number() OVER (PARTITION BY t.video, t.frame, t.det_idx ORDER BY (a.x2 - a.x1) * (a.y2 - a.y1), a.det_idx) AS rn
      FROM detections t JOIN detections a ON a.video = t.video AND a.frame = t.frame AND a.cls = 0 AND t.cls = 1
      AND (t.x1 + t.x2) / 2 BETWEEN a.x1 - 10 AND a.x2 + 10 AND (t.y1 + t.y2) / 2 BETWEEN a.y1 - 10 AND a.y2 + 10) p WHERE rn = 1"""


@frame("smallest_container", "SELECT video, frame, tag, animal FROM boxes", ("detections",), {"boxes": container_sql})
def smallest_container(spark, sf_dir):
    d = adapter(spark, sf_dir, "detections")
    a, t = prefixed(d.where("cls = 0"), "a_"), prefixed(d.where("cls = 1"), "t_")
    w = Window.partitionBy("video", "frame", "t_det_idx").orderBy(g.area(*(f"a_{c}" for c in BOX)), "a_det_idx")
    pairs = t.join(a, ["video", "frame"]).where(g.inside(g.center("t_x1", "t_x2"), g.center("t_y1", "t_y2"), "a_", 10))
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("video", "frame", F.col("t_det_idx").alias("tag"), F.col("a_det_idx").alias("animal"))


@relational("union_tag_box", "detections", more={"boxes": container_sql})
def union_tag_box(d):
    return "SELECT video, frame, animal, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(conf), 6) AS score, count(*) AS n FROM boxes GROUP BY video, frame, animal"


@frame("zero_detections", "SELECT count(*) AS images, count(*) FILTER (WHERE n IS NULL) AS without_box, count(*) FILTER (WHERE remote_id IS NULL) AS without_remote FROM images i LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) b ON b.l_orderkey = i.image_id", ("images",))
def zero_detections(spark, sf_dir):
    boxes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("has", F.lit(True))
    return adapter(spark, sf_dir, "images").join(boxes, "image_id", "left").agg(F.count("*").alias("images"), F.count_if(F.col("has").isNull()).alias("without_box"), F.count_if(F.col("remote_id").isNull()).alias("without_remote"))


BOXES = "(SELECT l_orderkey AS image_id, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS category_id, 20 + l_quantity AS w, 20 + l_partkey % 40 AS h, l_linenumber, l_partkey, l_suppkey FROM {lineitem})"


@frame("coco_rollup", f"""SELECT i.image_id, CAST(dense_rank() OVER (ORDER BY i.image_id) AS BIGINT) AS coco_id, count(b.category_id) AS boxes, coalesce(CAST(sum(b.category_id) AS BIGINT), 0) AS categories, round(coalesce(sum(b.w * b.h), 0), 3) AS area
      FROM images i LEFT JOIN {BOXES.format(lineitem='lineitem')} b ON b.image_id = i.image_id GROUP BY i.image_id""", ("images",))  # fmt: skip
def coco_rollup(spark, sf_dir):
    """Images, also those without boxes, numbered in the order of their ids."""
    boxes = spark.sql("SELECT * FROM " + BOXES.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    sums = boxes.groupBy("image_id").agg(F.count("*").alias("boxes"), F.sum("category_id").alias("categories"), F.round(F.sum(F.col("w") * F.col("h")), 3).alias("area"))
    rows = adapter(spark, sf_dir, "images").select("image_id").distinct().join(sums, "image_id", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return numbered(rows, "coco_id", "image_id").select("image_id", "coco_id", zero("boxes", "long"), zero("categories", "long"), zero("area", "double"))


@frame("annotation_lists", f"""SELECT i.image_id, coalesce(string_agg(CAST(b.category_id AS VARCHAR) || ':' || CAST(CAST(b.h AS BIGINT) AS VARCHAR), ',' ORDER BY b.l_linenumber, b.l_partkey, b.l_suppkey, b.w), '') AS annotations
      FROM images i LEFT JOIN {BOXES.format(lineitem='lineitem')} b ON b.image_id = i.image_id GROUP BY i.image_id""", ("images",))  # fmt: skip
def annotation_lists(spark, sf_dir):
    """An image's annotations as an ordered list; images without any have an empty one."""
    boxes = spark.sql("SELECT * FROM " + BOXES.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    one = F.concat_ws(":", "category_id", F.col("h").cast("long")).alias("text")
    lists = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "w", one))).alias("all"))
    return adapter(spark, sf_dir, "images").select("image_id").join(lists, "image_id", "left").select("image_id", F.coalesce(F.array_join(F.col("all.text"), ","), F.lit("")).alias("annotations"))


@relational("carry_detections", "detections")
def carry_detections(d):
    """Frames between strided ones repeat the detections of the last strided frame."""
    return "SELECT f.video, f.frame, s.det_idx, s.conf FROM (SELECT DISTINCT video, frame FROM detections) f JOIN detections s ON s.video = f.video AND s.frame = f.frame - f.frame % 5"


@relational("det_ordinals", "detections")
def det_ordinals(d):
    """Ordinals count before empty crops go, so they have gaps."""
    return "SELECT video, frame, det_idx, tag_idx FROM (SELECT video, frame, det_idx, x1, CAST(row_number() OVER (PARTITION BY video, frame, cls ORDER BY det_idx) - 1 AS BIGINT) AS tag_idx FROM detections) t WHERE x1 < 470"


def survivors(b: np.ndarray, limit: float) -> list[int]:
    """Greedy non-maximum suppression of boxes in order of preference."""
    area, alive, kept = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), np.ones(len(b), bool), []
    for i in range(len(b)):
        if alive[i]:
            kept.append(i)
            w = np.minimum(b[i, 2], b[:, 2]) - np.maximum(b[i, 0], b[:, 0])
            h = np.minimum(b[i, 3], b[:, 3]) - np.maximum(b[i, 1], b[:, 1])
            both = np.clip(w, 0, None) * np.clip(h, 0, None)
            alive &= both <= limit * (area[i] + area - both)
    return kept


def suppress(pdf: pd.DataFrame, limit: float = 0.4) -> pd.DataFrame:
    """Non-maximum suppression of each frame and class, by confidence, then ordinal. A group holds many frames."""
    pdf = pdf.iloc[np.lexsort((pdf["det_idx"], -pdf["conf"], pdf["cls"], pdf["frame"]))]
    key, boxes = pdf[["frame", "cls"]].to_numpy(), pdf[list(BOX)].to_numpy(float)
    cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
    return pdf.iloc[[a + i for a, z in zip(cuts, cuts[1:]) for i in survivors(boxes[a:z], limit)]]  # noqa: B905


@frame("nms")
def nms(spark, sf_dir):
    """Frames are independent; 256 of them share a group, so that groups stay small and calls few."""
    d = adapter(spark, sf_dir, "detections")
    return d.groupBy("video", F.floor(F.col("frame") / 256).alias("part")).applyInPandas(lambda pdf: suppress(pdf), d.schema).select("video", "frame", "det_idx", "cls", "conf")
