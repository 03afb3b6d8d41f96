"""Readers and writers. Paths are any that Spark's file systems open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, kind: str, optional: bool = False) -> DataFrame:
    """A table with header; a missing optional file is an empty table. Backslashes in paths stay."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[kind])
    return spark.read.csv(path, header=True, schema=SCHEMAS[kind], escape="\0", enforceSchema=False)


def labelled_keys(spark: SparkSession, *paths: str, column: str = "crop_path") -> DataFrame:
    """Distinct keys of several optional label files."""
    out = spark.createDataFrame([], f"{column} string")
    for p in paths:
        if exists(spark, p):
            out = out.unionByName(spark.read.csv(p, header=True).select(column))
    return out.distinct()


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """image_id, file_name, name, x1, y1, x2, y2; images without boxes stay."""
    doc = spark.read.json(path, schema=SCHEMAS["coco"], multiLine=True)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    boxes = doc.select(F.inline("annotations")).select("image_id", "category_id", "bbox")
    names = doc.select(F.inline("categories")).withColumnRenamed("id", "category_id")
    b = F.col("bbox")
    return images.join(boxes.join(names, "category_id", "left"), "image_id", "left").select("image_id", "file_name", "name", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"))


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row with the document as JSON: an export of one annotation set, not of a corpus."""
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    return pack(images, "images").crossJoin(pack(annotations, "annotations")).crossJoin(pack(categories, "categories")).select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def voc_xml(boxes: DataFrame) -> DataFrame:
    """file_name, xml: corners rounded half to even. boxes: file_name, width, height, det_idx, name, x1, y1, x2, y2."""
    corner = lambda c: F.bround(c).cast("int")
    one = F.format_string("<object><name>%s</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", escaped(F.col("name")), *(corner(c) for c in ("x1", "y1", "x2", "y2")))
    rows = boxes.withColumn("object", F.struct("det_idx", F.when(F.col("name").isNotNull(), one).alias("xml")))
    parts = rows.groupBy("file_name", "width", "height").agg(F.array_sort(F.collect_list("object")).alias("objects"))
    body = F.array_join(F.transform("objects", lambda o: o["xml"]), "")
    return parts.select("file_name", F.format_string("<annotation><filename>%s</filename><size><width>%d</width><height>%d</height><depth>3</depth></size>%s</annotation>", escaped(F.col("file_name")), "width", "height", body).alias("xml"))


def read_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Decoded images; those that can't be decoded go."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(path).select("image.*")


def list_files(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length").orderBy("path")


def class_names(spark: SparkSession, text: str) -> DataFrame:
    """class_id, name from the names entry of a YAML text: a list, or a mapping by number."""
    rows, inside = [], False
    for line in text.splitlines():
        if line.startswith("names:"):
            inside, rest = True, line[6:].strip()
            if rest.startswith("["):
                return spark.createDataFrame(list(enumerate(x.strip().strip("'\"") for x in rest.strip("[]").split(","))), "class_id int, name string")
        elif inside and line[:1] not in (" ", "-"):
            break
        elif inside and line.strip().startswith("-"):
            rows.append((len(rows), line.strip()[1:].strip().strip("'\"")))
        elif inside and ":" in line:
            k, v = line.split(":", 1)
            rows.append((int(k), v.strip().strip("'\"")))
    return spark.createDataFrame(rows, "class_id int, name string")


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    df.select(*columns).write.mode(mode).csv(path, header=True, escape="\0", emptyValue="")


def append_log(df: DataFrame, path: str) -> None:
    """Decision log: rows are only ever added."""
    df.write.mode("append").parquet(path)


def write_by(df: DataFrame, path: str, *columns: str, parts: int = 8) -> None:
    """One folder a value. A value's rows are dealt to `parts` tasks, so that a frequent one is not written by one alone."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    df.repartition(*map(F.col, columns), part).write.mode("overwrite").partitionBy(*columns).parquet(path)


def rewrite(spark: SparkSession, path: str, change) -> None:
    """Replace a table by change(table): written beside it, then swapped. recover() finishes a swap that was cut off."""
    recover(spark, path)
    fs, path_of = file_system(spark, path)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path}.new")
    fs.rename(path_of(path), path_of(f"{path}.old"))
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """If the table is gone from its path, the new one takes its place (or the old one, where none was written whole); then the old one goes."""
    fs, path_of = file_system(spark, path)
    if not fs.exists(path_of(path)):
        whole = fs.exists(path_of(f"{path}.new/_SUCCESS"))
        if whole or fs.exists(path_of(f"{path}.old")):
            fs.rename(path_of(f"{path}.new" if whole else f"{path}.old"), path_of(path))
    if fs.exists(path_of(path)) and fs.exists(path_of(f"{path}.old")):
        fs.delete(path_of(f"{path}.old"), True)
    spark.catalog.refreshByPath(path)


def file_system(spark: SparkSession, path: str):
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path_of


def from_existing(spark: SparkSession, path: str, least: float, excluded: tuple[str, ...] = ("0",)) -> DataFrame:
    """Accepted rows of a written prediction table (pred_text, score), filtered anew without running the model."""
    return spark.read.parquet(path).where(F.col("pred_text").rlike("^[0-9]$") & ~F.col("pred_text").isin(*excluded) & (F.col("score") >= least))


def scene_check(spark: SparkSession, source: str, weights: tuple[str, ...] = (), shown: bool = True, saved: str | None = None) -> list[str]:
    """What keeps a run from starting; empty if nothing does."""
    bad = [f"not found: {p}" for p in (source, *weights) if not exists(spark, p)]
    if not shown and saved is None:
        bad.append("nothing to do: neither shown nor saved")
    return bad
