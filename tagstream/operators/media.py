"""Frames and files: sampling, probes, paths, label texts and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import adapter, frame, relational

FPS, RATE, LIMIT, COLUMNS = 25.0, 1.0, 20, 6


@frame("frame_seek", f"""SELECT video, frame, det_idx FROM detections WHERE (video, frame) IN (
  SELECT v.video, CAST(floor(CAST(k.i * (v.total - 1) AS DOUBLE) / 11) AS BIGINT) FROM (SELECT video, max(frame) + 1 AS total FROM detections GROUP BY video) v, generate_series(0, 11) k(i))""", ("detections",))  # fmt: skip
def frame_seek(spark, sf_dir):
    """Detections of 12 frames a video, evenly spread over it: a semi-join on a few (video, frame) keys."""
    d = adapter(spark, sf_dir, "detections")
    wanted = d.groupBy("video").agg((F.max("frame") + 1).alias("total")).select("video", "total", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    wanted = wanted.select("video", F.floor(F.col("i") * (F.col("total") - 1) / F.lit(11.0)).alias("frame")).distinct()
    return d.join(wanted, ["video", "frame"], "left_semi").select("video", "frame", "det_idx")  # 12 rows a video: broadcast by Spark where they are few


@frame("rate_sample", f"SELECT video, min(frame) AS frame, CAST(floor(frame / {FPS} * {RATE}) AS BIGINT) AS bucket FROM detections GROUP BY video, CAST(floor(frame / {FPS} * {RATE}) AS BIGINT)", ("detections",))
def rate_sample(spark, sf_dir):
    """The first frame of each 1 / RATE seconds."""
    bucket = F.floor(F.col("frame") / FPS * RATE)
    return adapter(spark, sf_dir, "detections").groupBy("video", bucket.alias("bucket")).agg(F.min("frame").alias("frame"))


def limited(d: DataFrame, stride: int, limit: int) -> DataFrame:
    """Rows of every stride-th frame, of the first `limit` such frames a video; 0 is no limit."""
    d = d.where(F.col("frame") % stride == 0)
    if not limit:
        return d
    place = F.row_number().over(Window.partitionBy("video").orderBy("frame"))
    first = d.select("video", "frame").distinct().withColumn("place", place).where(F.col("place") <= limit).drop("place")
    return d.join(first, ["video", "frame"], "left_semi")


@frame("limited_sample", f"SELECT video, frame, det_idx FROM (SELECT *, dense_rank() OVER (PARTITION BY video ORDER BY frame) AS place FROM detections WHERE frame % 5 = 0) t WHERE place <= {LIMIT}", ("detections",))
def limited_sample(spark, sf_dir):
    return limited(adapter(spark, sf_dir, "detections"), 5, LIMIT).select("video", "frame", "det_idx")


@frame("unlimited_sample", "SELECT video, frame, det_idx FROM detections WHERE frame % 5 = 0", ("detections",))
def unlimited_sample(spark, sf_dir):
    return limited(adapter(spark, sf_dir, "detections"), 5, 0).select("video", "frame", "det_idx")


@frame("sequential_scan", "SELECT video, frame, det_idx FROM (SELECT *, dense_rank() OVER (PARTITION BY video ORDER BY frame) - 1 AS place FROM detections WHERE conf >= 0.3) t WHERE place = frame", ("detections",))
def sequential_scan(spark, sf_dir):
    """Frames from 0 on until the first that can't be read: here, one without a detection that is sure enough."""
    d = adapter(spark, sf_dir, "detections").where("conf >= 0.3")
    seen = d.select("video", "frame").distinct()
    after = seen.select("video", (F.col("frame") + 1).alias("frame")).unionByName(seen.select("video").distinct().withColumn("frame", F.lit(0).cast("long")))
    end = after.join(seen, ["video", "frame"], "left_anti").groupBy("video").agg(F.min("frame").alias("end"))  # the first gap
    return d.join(end, "video").where("frame < end").select("video", "frame", "det_idx")


def duration_text(seconds):
    """H:MM:SS.ss; 59.999 seconds are 60.00."""
    rest = seconds % 3600
    return F.format_string("%d:%02d:%05.2f", F.floor(seconds / 3600), F.floor(rest / 60), seconds % 60)


def fourcc(code):
    """Four characters, the lowest byte first."""
    return F.concat(*(F.chr(F.shiftright(code, 8 * k).bitwiseAND(F.lit(255))) for k in range(4)))


def probe(d: DataFrame) -> DataFrame:
    """From file, bytes, width, height, fps, frame_count, code: what a probe reports; an fps of 0 makes no duration, and 25 for all that needs one."""
    seconds = F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(F.lit(0.0))
    return d.select(
        "file", F.round(F.col("bytes") / (1024 * 1024), 1).alias("size_mb"), "width", "height", F.round("fps", 3).alias("fps"), "frame_count",
        F.round(seconds, 1).alias("duration_s"), duration_text(seconds).alias("duration_hms"), fourcc(F.col("code")).alias("fourcc"),
        F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(FPS)).alias("rate"),
    )


PROBED = """SELECT file_name AS file, CAST(image_id * 40961 AS BIGINT) AS bytes, width, height, CASE WHEN image_id % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(25 AS DOUBLE) / (1 + image_id % 2) END AS fps,
  CAST(image_id * 3 AS BIGINT) AS frame_count, CASE WHEN image_id % 2 = 0 THEN CAST(875967080 AS BIGINT) ELSE CAST(1983148141 AS BIGINT) END AS code FROM images"""


@frame("probe_record", """SELECT file, round(bytes / 1048576.0, 1) AS size_mb, width, height, round(fps, 3) AS fps, frame_count, round(s, 1) AS duration_s,
  printf('%d:%02d:%05.2f', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) AS duration_hms,
  concat(chr(CAST(code & 255 AS INT)), chr(CAST((code >> 8) & 255 AS INT)), chr(CAST((code >> 16) & 255 AS INT)), chr(CAST((code >> 24) & 255 AS INT))) AS fourcc, CASE WHEN fps = 0 THEN 25.0 ELSE fps END::DOUBLE AS rate
  FROM (SELECT *, CASE WHEN fps > 0 THEN frame_count / fps ELSE CAST(0 AS DOUBLE) END AS s FROM files) t""", ("images",), {"files": lambda d: PROBED})  # fmt: skip
def probe_record(spark, sf_dir):
    return probe(spark.sql(PROBED.replace("FROM images", "FROM {images}"), images=adapter(spark, sf_dir, "images")))


@frame("size_totals", "SELECT count(*) AS files, round(sum(bytes) / 1048576.0, 3) AS total_mb, round(sum(bytes) / 1048576.0 / greatest(count(*), 1), 6) AS mean_mb FROM files", ("images",), {"files": lambda d: PROBED})
def size_totals(spark, sf_dir):
    total = F.sum(F.col("image_id") * 40961) / 1048576.0
    return adapter(spark, sf_dir, "images").agg(F.count("*").alias("files"), F.round(total, 3).alias("total_mb"), F.round(total / F.greatest(F.count("*"), F.lit(1)), 6).alias("mean_mb"))


ROOT = "C:/work/project"
PATHS = "SELECT image_id, CASE image_id % 4 WHEN 0 THEN concat('C:\\work\\project\\data\\', file_name) WHEN 1 THEN concat('C:/work/project/data/', replace(file_name, '.jpg', '.JPG')) WHEN 2 THEN concat('/other/', file_name) ELSE concat('C:/work/projects/', file_name) END AS path FROM images"


def relative_to(path, root: str):
    """The part below root; paths elsewhere stay whole. Both separators count."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(plain, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def basename(path):
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(name):
    """From the last dot on, lower case; none for names that start with their only dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def stem(name):
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


@frame("path_parts", f"""SELECT image_id, CASE WHEN starts_with(plain, '{ROOT}/') THEN substr(path, {len(ROOT) + 2}) ELSE path END AS relative, name, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS suffix, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem
  FROM (SELECT *, replace(path, '\\', '/') AS plain, regexp_extract(replace(path, '\\', '/'), '([^/]*)$', 1) AS name FROM paths) t""", ("images",), {"paths": lambda d: PATHS})  # fmt: skip
def path_parts(spark, sf_dir):
    i = F.col("image_id") % 4
    j = lambda a, b: F.concat(F.lit(a), b)
    name = F.col("file_name")
    path = F.when(i == 0, j("C:\\work\\project\\data\\", name)).when(i == 1, j("C:/work/project/data/", F.replace(name, F.lit(".jpg"), F.lit(".JPG")))).when(i == 2, j("/other/", name)).otherwise(j("C:/work/projects/", name))
    d = adapter(spark, sf_dir, "images").select("image_id", path.alias("path"))
    return d.select("image_id", relative_to(F.col("path"), ROOT).alias("relative"), basename(F.col("path")).alias("name"), suffix(basename(F.col("path"))).alias("suffix"), stem(basename(F.col("path"))).alias("stem"))


READS = "SELECT crop_id, list(pred_text ORDER BY pos) AS texts, list(score ORDER BY pos) AS scores FROM auto_preds WHERE pos % 3 > 0 GROUP BY crop_id"


def reads(spark, sf_dir) -> DataFrame:
    """crop_id, texts, scores: the results of one recognition of each crop; none, one or more."""
    p = adapter(spark, sf_dir, "auto_preds").where("pos % 3 > 0").groupBy("crop_id").agg(F.array_sort(F.collect_list(F.struct("pos", "pred_text", "score"))).alias("r"))
    return p.select("crop_id", F.col("r.pred_text").alias("texts"), F.col("r.score").alias("scores"))


def label_text(texts, scores):
    """The texts with a blank between, and the best score; '(none)' and 0 without any. 22 characters at most; halves are rounded up."""
    score = F.coalesce(F.array_max(scores), F.lit(0.0))
    text = F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.array_join(texts, " ")).otherwise("(none)")
    return F.substring(F.format_string("%s (%.2f)", text, score), 1, 22)


@frame("label_texts", """SELECT c.crop_id, substr(concat(coalesce(array_to_string(r.texts, ' '), '(none)'), ' (', CAST(CAST(round(CAST(coalesce(list_max(r.scores), 0.0) AS DECIMAL(12, 6)), 2) AS DECIMAL(12, 2)) AS VARCHAR), ')'), 1, 22) AS label, coalesce(list_max(r.scores), 0.0)::DOUBLE AS best
  FROM crops c LEFT JOIN r ON r.crop_id = c.crop_id""", ("crops", "auto_preds"), {"r": lambda d: READS})  # fmt: skip
def label_texts(spark, sf_dir):
    rows = adapter(spark, sf_dir, "crops").select("crop_id").join(reads(spark, sf_dir), "crop_id", "left")
    return rows.select("crop_id", label_text(F.col("texts"), F.col("scores")).alias("label"), F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best"))


def normalized(text):
    x = F.upper(F.trim(text))
    return F.when(x == "O", "0").when(x.rlike("^[0-9]$"), x)


@frame("bootstrap_accept", "SELECT crop_id, CASE WHEN upper(trim(texts[1])) = 'O' THEN '0' ELSE upper(trim(texts[1])) END AS digit FROM r WHERE len(texts) = 1 AND scores[1] >= 0.5 AND (upper(trim(texts[1])) = 'O' OR regexp_full_match(upper(trim(texts[1])), '[0-9]'))", ("auto_preds",), {"r": lambda d: READS})
def bootstrap_accept(spark, sf_dir):
    """Crops with exactly one text, of a score of 0.5 or more, that is a digit."""
    r = reads(spark, sf_dir).where((F.size("texts") == 1) & (F.element_at("scores", 1) >= 0.5))
    return r.select("crop_id", normalized(F.element_at("texts", 1)).alias("digit")).where("digit IS NOT NULL")


@frame("grid_position", f"SELECT image_id, CAST((image_id // {COLUMNS}) AS BIGINT) AS row, CAST(image_id % {COLUMNS} AS BIGINT) AS col FROM images", ("images",))
def grid_position(spark, sf_dir):
    """Place on a sheet of six columns."""
    return adapter(spark, sf_dir, "images").select("image_id", F.floor(F.col("image_id") / COLUMNS).alias("row"), (F.col("image_id") % COLUMNS).alias("col"))


@frame("video_list", "SELECT DISTINCT video FROM detections ORDER BY video", ("detections",))
def video_list(spark, sf_dir):
    return adapter(spark, sf_dir, "detections").select("video").distinct().orderBy("video")


@frame("zip_join", "SELECT a.video, a.frame, a.at, a.det_idx AS animal, t.det_idx AS tag FROM o a JOIN o t ON a.video = t.video AND a.frame = t.frame AND a.at = t.at AND a.cls = 0 AND t.cls = 1", ("detections",), {"o": lambda d: "SELECT *, CAST(row_number() OVER (PARTITION BY video, frame, cls ORDER BY det_idx) - 1 AS BIGINT) AS at FROM detections"})
def zip_join(spark, sf_dir):
    """A frame's animals and tags paired by place, up to the shorter list."""
    lists = adapter(spark, sf_dir, "detections").groupBy("video", "frame").agg(*(F.array_sort(F.collect_list(F.when(F.col("cls") == k, F.col("det_idx")))).alias(n) for k, n in ((0, "animal"), (1, "tag"))))
    pairs = F.slice(F.arrays_zip("animal", "tag"), F.lit(1), F.least(F.size("animal"), F.size("tag")))
    return lists.select("video", "frame", F.posexplode(pairs).alias("at", "p")).select("video", "frame", F.col("at").cast("long").alias("at"), "p.animal", "p.tag")


def flattened(pages: DataFrame) -> DataFrame:
    """From page and items array<struct<name, id>>: id of each name, the last one of all pages."""
    rows = pages.select("page", F.posexplode("items").alias("at", "item"))
    return rows.groupBy(F.col("item.name").alias("name")).agg(F.max_by("item.id", F.struct("page", "at")).alias("id"))


@frame("remote_listing", "SELECT name, max(image_id) AS id FROM (SELECT image_id, concat('frame_', CAST(image_id % 500 AS VARCHAR)) AS name FROM images) t GROUP BY name", ("images",))
def remote_listing(spark, sf_dir):
    """A listing in pages of 100 items, flattened."""
    items = adapter(spark, sf_dir, "images").select(F.floor(F.col("image_id") / 100).alias("page"), F.struct("image_id", F.concat(F.lit("frame_"), (F.col("image_id") % 500).cast("string")).alias("name"), F.col("image_id").alias("id")).alias("i"))
    pages = items.groupBy("page").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: F.struct(i["name"].alias("name"), i["id"].alias("id"))).alias("items"))
    return flattened(pages)


@relational("augment_draws", "synthetic")
def augment_draws(d):
    """Parameters of each copy, drawn by hashes of its number: rotation, scale, brightness, contrast, blur (0 is none)."""
    u = lambda k: f"(CAST({d.hexed(f'''substr(md5(concat('{k}|', CAST(crop_id AS VARCHAR(20)))), 1, 7)''')} AS DOUBLE) / 268435456.0)"
    return f"""SELECT crop_id, round(-15 + 30 * {u('rotation')}, 6) AS rotation, round(0.92 + 0.16 * {u('scale')}, 6) AS scale, round(0.8 + 0.4 * {u('brightness')}, 6) AS brightness, round(0.9 + 0.2 * {u('contrast')}, 6) AS contrast,
      CASE WHEN {u('blur')} >= 0.5 THEN 0 WHEN {u('kernel')} < 0.5 THEN 3 ELSE 5 END AS blur, round((rotation_deg - 15 + 30 * {u('rotation')} + 360) % 360, 1) AS rotation_deg FROM synthetic"""


@frame("ocr_rows", "SELECT crop_id, CAST(i - 1 AS INT) AS at, texts[i] AS text, scores[i] AS score FROM r, generate_series(1, 50) t(i) WHERE i <= len(texts)", ("auto_preds",), {"r": lambda d: READS})
def ocr_rows(spark, sf_dir):
    """None to many rows a crop, by a table function over the recognizer's result as JSON."""
    from ..functions.udtf import RecognizedTexts

    spark.udtf.register("recognized_texts", RecognizedTexts)
    results = reads(spark, sf_dir).select("crop_id", F.to_json(F.struct(F.col("texts").alias("rec_texts"), F.col("scores").alias("rec_scores"))).alias("result"))
    return spark.sql("SELECT r.crop_id, t.at, t.text, t.score FROM {results} r, LATERAL recognized_texts(r.result) t", results=results)
