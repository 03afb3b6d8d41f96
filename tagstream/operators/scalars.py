"""Per-row queries: boxes, circles, angles, vectors, keys and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.dialect import adapter, frame, relational
from ..sources.adapters import CANVAS_H, CANVAS_W

PAD = 0.15


@frame("crop_padded", f"""SELECT video, frame, det_idx, px1, py1, px2, py2 FROM (SELECT video, frame, det_idx,
  CAST(greatest(0, trunc(x1 - (x2 - x1) * {PAD})) AS INT) AS px1, CAST(greatest(0, trunc(y1 - (y2 - y1) * {PAD})) AS INT) AS py1,
  CAST(least({CANVAS_W}, trunc(x2 + (x2 - x1) * {PAD})) AS INT) AS px2, CAST(least({CANVAS_H}, trunc(y2 + (y2 - y1) * {PAD})) AS INT) AS py2
  FROM detections) t WHERE px2 > px1 AND py2 > py1""", ("detections",))  # fmt: skip
def crop_padded(spark, sf_dir):
    """Padded boxes, truncated and clamped to the canvas; empty ones go."""
    (a, c), (b, e) = g.clamped("x1", "x2", PAD, CANVAS_W), g.clamped("y1", "y2", PAD, CANVAS_H)
    return adapter(spark, sf_dir, "detections").select("video", "frame", "det_idx", a.alias("px1"), b.alias("py1"), c.alias("px2"), e.alias("py2")).where("px2 > px1 AND py2 > py1")


@frame("box_metrics", """SELECT video, frame, det_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area,
  greatest(x2 - x1, y2 - y1) / 2 AS radius, round(sqrt(((x1 + x2) / 2) * ((x1 + x2) / 2) + ((y1 + y2) / 2) * ((y1 + y2) / 2)), 6) AS dist FROM detections""", ("detections",))
def box_metrics(spark, sf_dir):
    d = adapter(spark, sf_dir, "detections")
    w, h, cx, cy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), g.center("x1", "x2"), g.center("y1", "y2")
    return d.select("video", "frame", "det_idx", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), g.area("x1", "y1", "x2", "y2").alias("area"), (F.greatest(w, h) / 2).alias("radius"), F.round(F.hypot(cx, cy), 6).alias("dist"))


@relational("bead_boxes", "beads")
def bead_boxes(d):
    return "SELECT tag_id, bead_idx, round(cx - radius * 1.2, 6) AS x1, round(cy - radius * 1.2, 6) AS y1, round(cx + radius * 1.2, 6) AS x2, round(cy + radius * 1.2, 6) AS y2 FROM beads"


@relational("voc_round", "detections")
def voc_round(d):
    r = lambda c: f"{d.int(d.even(c))} AS {c}"
    return f"SELECT video, frame, det_idx, {r('x1')}, {r('y1')}, {r('x2')}, {r('y2')}, replace(replace(replace(concat('<a & b>', CAST(cls AS VARCHAR(2))), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS name FROM detections"


@relational("angle_roundtrip", "synthetic")
def angle_roundtrip(d):
    s, c = "sin(radians(rotation_deg))", "cos(radians(rotation_deg))"
    back = f"((degrees(atan2({s}, {c})) % 360) + 360) % 360"
    err = "((rotation_deg - 90 + 180) % 360 + 360) % 360 - 180"
    return f"SELECT crop_id, round({s}, 6) + CAST(0 AS DOUBLE) AS s, round({c}, 6) + CAST(0 AS DOUBLE) AS c, round(abs((({back}) - rotation_deg + 540) % 360 - 180), 6) AS back, round(abs({err}), 6) AS error_to_90, round((rotation_deg + 15) % 360, 1) AS turned FROM synthetic"


@relational("unit_vectors", "beads")
def unit_vectors(d):
    n = "sqrt(cx * cx + cy * cy)"
    return f"SELECT tag_id, bead_idx, round({n}, 6) AS norm, round(CASE WHEN {n} > 0.000001 THEN cx / {n} ELSE 0.0 END, 6) AS ux, round(CASE WHEN {n} > 0.000001 THEN cy / {n} ELSE 0.0 END, 6) AS uy FROM beads"


@frame("softmax_top1", """SELECT crop_id, list_position(l, list_max(l)) - 1 AS pred, round(1.0 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))), 6) AS p
  FROM (SELECT crop_id, list_transform(embedding[1:9], lambda v: CAST(v AS DOUBLE)) AS l FROM features) t""", ("features",))  # fmt: skip
def softmax_top1(spark, sf_dir):
    """Class and probability of the first largest of nine logits."""
    f = adapter(spark, sf_dir, "features").select("crop_id", F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double")).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("l")))
    return f.select("crop_id", (F.array_position("l", F.array_max("l")) - 1).cast("int").alias("pred"), F.round(1 / total, 6).alias("p"))


@relational("upscale_dims", "detections")
def upscale_dims(d):
    k = f"greatest(1, {d.int('floor(160 / (y2 - y1))')})"
    return f"SELECT video, frame, det_idx, {k} AS k, {d.int(f'(x2 - x1) * {k}')} AS w, {d.int(f'(y2 - y1) * {k}')} AS h FROM detections"


@relational("key_format", "detections")
def key_format(d):
    return f"SELECT video, frame, det_idx, concat('v', CAST(video AS VARCHAR(20)), '_frame', {d.pad('frame', 6)}, '_tag', CAST(det_idx AS VARCHAR(20)), '_bead0.jpg') AS name, CAST(det_idx % 8 AS BIGINT) AS colour, CASE cls WHEN 0 THEN 'animal' WHEN 1 THEN 'tag' END AS class_name FROM detections"


@relational("duration_hms", "images")
def duration_hms(d):
    s = "(image_id * 40)"  # milliseconds at 25 frames a second
    return f"SELECT image_id, concat(CAST({d.int(f'floor({s} / 3600000.0)')} AS VARCHAR(20)), ':', {d.pad(d.int(f'floor({s} % 3600000 / 60000.0)'), 2)}, ':', {d.pad(d.int(f'floor({s} % 60000 / 1000.0)'), 2)}, '.', {d.pad(d.int(f'floor({s} % 1000 / 10.0)'), 2)}) AS hms FROM images"


@relational("aug_index", "synthetic")
def aug_index(d):
    key = "concat('crop_', CAST(source_crop_id AS VARCHAR(20)), '_aug', CASE WHEN crop_id % 7 = 0 THEN 'x' ELSE CAST(crop_id % 50 AS VARCHAR(20)) END)"
    got = d.extract(key, "_aug([0-9]+)$", 1)
    return f"SELECT source_crop_id, max(CASE WHEN {got} <> '' THEN CAST(concat('0', {got}) AS BIGINT) END) + 1 AS next_index FROM synthetic GROUP BY source_crop_id"


@frame("hash_bits", """SELECT crop_id, list_sum(list_transform(generate_series(1, 63), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END))::BIGINT AS hash FROM features""", ("features",))
def hash_bits(spark, sf_dir):
    """Comparisons of neighbours packed into bits, first one lowest."""
    bit = lambda i: F.when(F.element_at("embedding", i + 1) > F.element_at("embedding", i), F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long"))
    return adapter(spark, sf_dir, "features").select("crop_id", F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, v: a + v).alias("hash"))


@frame("class_demux", "SELECT video, frame, det_idx, cls, conf FROM detections WHERE cls = 1 AND conf >= 0.4", ("detections",))
def class_demux(spark, sf_dir):
    return adapter(spark, sf_dir, "detections").where("cls = 1 AND conf >= 0.4").select("video", "frame", "det_idx", "cls", "conf")


@frame("stride_sample", "SELECT video, frame, det_idx FROM detections WHERE frame % 25 = 0", ("detections",))
def stride_sample(spark, sf_dir):
    return adapter(spark, sf_dir, "detections").where("frame % 25 = 0").select("video", "frame", "det_idx")


@relational("even_sample", "detections")
def even_sample(d):
    """40 ordinals a video, or all of fewer, evenly spread and truncated."""
    return f"""SELECT o.video, o.frame, o.det_idx, o.at FROM (SELECT video, frame, det_idx, CAST(row_number() OVER (PARTITION BY video ORDER BY frame, det_idx) - 1 AS BIGINT) AS at, count(*) OVER (PARTITION BY video) AS n FROM detections) o
      JOIN (SELECT DISTINCT c.video, {d.int('floor(CAST(k.i * (c.n - 1) AS DOUBLE) / greatest(1, least(40, c.n) - 1))')} AS at FROM (SELECT video, count(*) AS n FROM detections GROUP BY video) c, {d.explode(0, 39)} AS k(i) WHERE k.i < c.n) s ON s.video = o.video AND s.at = o.at"""


@relational("soft_cap", "detections")
def soft_cap(d):
    """Whole frames until 40 rows are reached: the last frame may exceed it."""
    return """SELECT d.video, d.frame, d.det_idx FROM detections d JOIN (
        SELECT video, frame, coalesce(sum(n) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT video, frame, count(*) AS n FROM detections WHERE cls = 1 GROUP BY video, frame) f) c ON c.video = d.video AND c.frame = d.frame
      WHERE d.cls = 1 AND c.before < 40"""


@relational("min_group", "beads")
def min_group(d):
    return "SELECT tag_id, bead_idx FROM (SELECT tag_id, bead_idx, count(*) OVER (PARTITION BY tag_id) AS n FROM beads) t WHERE n >= 3"
