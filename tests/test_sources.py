"""Paged listings and the exactly-once log."""

import json

import pytest

from tagstream.sources import listing
from tagstream.streaming import log


@pytest.fixture
def pages(tmp_path):
    for page in range(12):
        items = [{"name": f"f{(page * 7 + k) % 30}", "id": page * 100 + k} for k in range(10)] if page != 5 else []
        (tmp_path / f"page-{page:03d}.json").write_text(json.dumps({"items": items}))
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "page-90.json").write_text(json.dumps({"items": [{"id": 1}, {"name": "late"}]}))
    return str(tmp_path)


def test_pages_and_last_wins(spark, pages):
    df = listing.read_listing(spark, pages)
    want = {f"f{(p * 7 + k) % 30}": p * 100 + k for p in range(12) if p != 5 for k in range(10)} | {"late": None}
    assert df.count() == 112 and {r.name: r.id for r in listing.latest_ids(df).collect()} == want


def test_a_range_of_pages_reads_no_others(spark, pages, tmp_path):
    (tmp_path / "page-004.json").write_text("this is no page")
    for first, last, n in ((7, None, 6), (8, 9, 2), (1, 3, 3), (5, 5, 1), (77, 78, 1)):
        df = listing.read_listing(spark, pages, first, last)
        assert df.rdd.getNumPartitions() == n
        got = {r.page for r in df.collect()}
        assert got == {p for p in [*range(12), 90] if first <= p <= (last or 99) and p != 5}
        assert {r.page for r in df.where("page = 8").collect()} == got & {8} and {r.page for r in df.collect()} == got
    with pytest.raises(Exception, match="JSONDecodeError"):
        listing.read_listing(spark, pages).count()


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    path, fields = str(tmp_path / "log"), "crop_id long, digit string"
    assert log.read_log(spark, path, fields).count() == 0
    rows = lambda *ids: spark.createDataFrame([(i, str(i)) for i in ids], fields)
    write = log.append_once(path, "labels")
    write(rows(1, 2), 0)
    write(rows(3), 1)
    write(rows(3), 1)  # replayed after its end
    spark.createDataFrame([(4, "4")], fields).write.parquet(f"{path}/query=labels/batch=2")
    (tmp_path / "log" / "query=labels" / "batch=2" / "_SUCCESS").unlink()  # cut off
    seen = lambda: sorted((r.crop_id, r.query, r.batch) for r in log.read_log(spark, path, fields).collect())
    assert seen() == [(1, "labels", 0), (2, "labels", 0), (3, "labels", 1)]
    write(rows(4, 5), 2)
    log.append_once(path, "other")(rows(9), 0)
    assert seen() == [(1, "labels", 0), (2, "labels", 0), (3, "labels", 1), (4, "labels", 2), (5, "labels", 2), (9, "other", 0)]


def test_a_restarted_stream_logs_each_row_once(spark, tmp_path):
    fields, path = "crop_id long, digit string", str(tmp_path / "log")
    once = log.append_once(path, "labels")

    def run(fail_at):
        def write(batch, number):
            once(batch, number)
            if number == fail_at:
                raise RuntimeError("lost after the write")

        source = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as e:
            assert "lost after the write" in str(e)
            return False
        return True

    for k in range(4):
        spark.createDataFrame([(10 * k + i, "7") for i in range(5)], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert not run(1) and not run(2) and run(-1)
    got = sorted(r.crop_id for r in log.read_log(spark, path, fields).collect())
    assert got == sorted(10 * k + i for k in range(4) for i in range(5))
