"""Streams that hold live leaders and tags."""

import pytest
from pyspark.sql import functions as F

from tagstream import catalog
from tagstream.plans.dialect import adapter
from tagstream.sources.schemas import SCHEMAS
from tagstream.streaming import leaders

SF = "/root/testdata/sf0.001"
DAY = 86_400_000
CROPS = "video long, crop_id long, frame long, hash long, ts timestamp"


@pytest.fixture
def store(spark):
    before = spark.conf.get(leaders.STORE)
    leaders.keeps_timers(spark)
    yield spark
    spark.conf.set(leaders.STORE, before)


def in_triggers(df, path, n, by="frame"):
    """df in n files of consecutive frames, the order in which a source reads them."""
    last = df.agg(F.max(by)).first()[0] + 1
    for k in range(n):
        df.where((F.col(by) >= last * k // n) & (F.col(by) < last * (k + 1) // n)).coalesce(1).write.mode("append").parquet(path)


def drained(stream, path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None, query.exception()
    return query


def test_leader_stream_equals_batch_and_forgets(store, tmp_path):
    spark = store
    crops = adapter(spark, SF, "crops").select("video", "crop_id", "frame", "hash", F.timestamp_millis(F.col("frame") * 40 + DAY).alias("ts"))
    in_triggers(crops, str(tmp_path / "in"), 5)
    source = spark.readStream.schema(CROPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = drained(leaders.leader_stream(source, 2, 30), str(tmp_path / "ck"), "leaders_out")
    got = sorted(map(tuple, spark.table("leaders_out").select("video", "crop_id", "cluster").collect()))
    batch = sorted(map(tuple, catalog.QUERIES["leader_clusters"](spark, SF).select("video", "crop_id", "cluster").collect()))
    assert len(query.recentProgress) >= 5 and got == batch and max(c for _, _, c in got) > 100
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 5 and max(held) <= 1.1 * held[0]  # a window of frames, whatever came before it


def test_timers_drop_leaders_of_videos_that_ended(store, tmp_path):
    spark = store
    rows = [(0, k, k, k * 1000, 40 * k) for k in range(20)] + [(1, 1000 + k, k, 7, 40 * k) for k in range(0, 2000, 10)]
    df = spark.createDataFrame(rows, "video long, crop_id long, frame long, hash long, ms long").select("video", "crop_id", "frame", "hash", F.timestamp_millis(F.col("ms") + DAY).alias("ts"))
    in_triggers(df, str(tmp_path / "in"), 6)
    source = spark.readStream.schema(CROPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = drained(leaders.leader_stream(source, 2, 30, late="1 second"), str(tmp_path / "ck"), "ended_out")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 20 and held[-1] <= 8  # a head a video, the one live leader and its timer
    got = {r.crop_id: r.cluster for r in spark.table("ended_out").collect()}
    assert len(got) == 220 and {got[c] for c in got if c >= 1000} == {0} and len({got[c] for c in range(20)}) > 1


def test_late_and_null_crops_are_dropped(store, tmp_path):
    spark = store
    first = [(0, 1, 5, 0, 200), (0, 2, 6, 0, 240), (0, 3, None, 0, 240), (0, 4, 6, None, 240)]
    later = [(0, 5, 6, 0, 240), (0, 6, 7, 1, 280)]
    for rows in (first, later):
        spark.createDataFrame(rows, "video long, crop_id long, frame long, hash long, ms long").select("video", "crop_id", "frame", "hash", F.timestamp_millis(F.col("ms") + DAY).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(CROPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(leaders.leader_stream(source, 2, 30), str(tmp_path / "ck"), "late_out")
    assert sorted(map(tuple, spark.table("late_out").select("crop_id", "cluster").collect())) == [(1, 0), (2, 0), (6, 0)]


def test_alive_stream_equals_batch(spark, tmp_path):
    d = adapter(spark, SF, "detections").where("cls = 1")
    in_triggers(d, str(tmp_path / "in"), 4)
    source = spark.readStream.schema(SCHEMAS["detections"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(leaders.alive_stream(source), str(tmp_path / "ck"), "alive_out")
    batch = catalog.QUERIES["alive_ids"](spark, SF)
    assert sorted(map(tuple, spark.table("alive_out").collect())) == sorted(map(tuple, batch.collect()))
