"""Containers, frames as a source, files as sinks."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagstream.sources import container, frames


def picture(video, k):
    return b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x30\x00\x40\x03" + f"{video}-{k}".encode() * (20 + k % 7) + b"\xff\xd9"


def written(pictures, fps=25.0, code=b"jpeg"):
    out = io.BytesIO()
    container.write_container(out, pictures, 64, 48, fps, code)
    return out.getvalue()


def indexed(raw):
    return container.read_index(io.BytesIO(raw), len(raw))


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    total = 0

    def read(self, n=-1):
        got = super().read(n)
        self.total += len(got)
        return got


def test_index_of_written_containers(monkeypatch):
    monkeypatch.setattr(container, "CHUNK", 3000)
    for n, fps in ((0, 25.0), (1, 30.0), (333, 12.5)):
        pictures = [picture("a", k) for k in range(n)]
        raw = written(pictures, fps)
        v = indexed(raw)
        assert (v.width, v.height, v.code, round(v.fps, 6)) == (64, 48, b"jpeg", fps if n else 0.0)
        assert [raw[o : o + s] for o, s in zip(v.offset, v.size, strict=True)] == pictures
        assert (v.time / v.scale).tolist() == pytest.approx([k / fps for k in range(n)])
        assert container.readable(io.BytesIO(raw), len(raw), v) == n


def test_the_index_alone_is_read():
    raw = written([bytes(100_000)] * 50, code=b"mp4v")
    f = Counted(raw)
    v = container.read_index(f, len(raw))
    assert len(v.size) == 50 == container.readable(f, len(raw), v) and f.total < 3000 < len(raw)


def test_cut_and_damaged_containers_give_reasons():
    raw = written([picture("a", k) for k in range(40)])
    movie = raw.rindex(b"moov") - 4
    for bad, says in (
        (b"", "no movie box"), (raw[:movie], "no movie box"), (raw[: movie + 50], "box moov at"), (b"\0\0\0\1", "cut in the header"), (struct.pack(">I4s", 4, b"free"), "is 4 bytes long"),
        (raw.replace(b"vide", b"soun"), "no video track"), (raw.replace(b"stsz", b"xxxx"), "no box stsz"), (raw.replace(b"co64", b"xxxx"), "no box stco"),
        (raw.replace(b"stsz\0\0\0\0\0\0\0\0\0\0\0\x28", b"stsz\0\0\0\0\0\0\0\0\0\0\0\xff"), "a table of 255 entries"),
        (raw.replace(b"stsz\0\0\0\0\0\0\0\0\0\0\0\x28", b"stsz\0\0\0\0\0\0\0\0\0\0\0\x27"), "39 frames, but 40 in chunks"),
    ):
        with pytest.raises(container.Damaged, match=says):
            indexed(bad)
    rng = np.random.default_rng(0)
    for _ in range(500):
        x = bytearray(raw)
        for _ in range(rng.integers(1, 4)):
            x[rng.integers(movie, len(raw))] = rng.integers(256)
        try:
            container.readable(io.BytesIO(bytes(x)), len(x), indexed(bytes(x)))
        except container.Damaged:
            pass


def test_first_frame_that_cannot_be_read():
    pictures = [picture("a", k) for k in range(20)]
    pictures[7] = b"no picture"
    raw = written(pictures)
    assert container.readable(io.BytesIO(raw), len(raw), indexed(raw)) == 7
    v = indexed(raw := written([picture("a", k) for k in range(20)]))
    assert container.readable(io.BytesIO(raw), int(v.offset[12]) + 3, v) == 12
    assert container.readable(io.BytesIO(raw), len(raw), v, 5, 9) == 9


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for v, n in (("a", 40), ("b", 41), ("c", 0)):
        (tmp_path / "in" / f"{v}.mp4").write_bytes(written([picture(v, k) for k in range(n)]))
    (tmp_path / "in" / "cut.mp4").write_bytes(written([picture("x", k) for k in range(9)])[:500])
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    return tmp_path


def test_probe_of_files(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in container.probe_files(spark, str(folder / "in")).collect()}
    assert set(got) == {"a.mp4", "b.mp4", "c.mp4", "cut.mp4"}
    assert (got["a.mp4"].frame_count, got["a.mp4"].readable, got["a.mp4"].fps, got["a.mp4"].error) == (40, 40, 25.0, None)
    assert got["cut.mp4"].error == "no movie box" and got["cut.mp4"].frame_count is None
    shown = {r.file: r for r in container.probe_videos(spark, str(folder / "in")).collect()}
    assert set(shown) == {"a.mp4", "b.mp4", "c.mp4"}
    assert (shown["a.mp4"].duration_hms, shown["a.mp4"].fourcc, shown["c.mp4"].fps, shown["c.mp4"].rate) == ("0:00:01.60", "jpeg", 0.0, 25.0)


def test_frames_in_batch(spark, folder):
    frames.register(spark)
    got = spark.read.format("frames").option("path", str(folder / "in")).option("framesPerTask", 16).load()
    assert {(r.video, r.frame): bytes(r.data) for r in got.collect()} == {(f"{v}.mp4", k): picture(v, k) for v, n in (("a", 40), ("b", 41)) for k in range(n)}
    assert got.rdd.getNumPartitions() == 6 and got.where("frame = 5").select("seconds").first()[0] == 0.2
    (folder / "none").mkdir()
    assert spark.read.format("frames").option("path", str(folder / "none")).load().count() == 0


def test_restart_repeats_and_loses_no_frame(spark, folder):
    frames.register(spark)

    def run():
        source = spark.readStream.format("frames").option("path", str(folder / "in")).load()
        query = source.writeStream.format("parquet").option("path", str(folder / "sink")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return {r.video: (r.n, r.different, r.last) for r in spark.read.parquet(str(folder / "sink")).groupBy("video").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("different"), F.max("frame").alias("last")).collect()}

    assert run() == {"a.mp4": (40, 40, 39), "b.mp4": (41, 41, 40)}
    (folder / "in" / "a.mp4").write_bytes(written([picture("a", k) for k in range(50)]))  # goes on
    (folder / "in" / "d.mp4").write_bytes(written([picture("d", k) if k != 7 else b"damaged" for k in range(20)]))  # ends
    assert run() == {"a.mp4": (50, 50, 49), "b.mp4": (41, 41, 40), "d.mp4": (7, 7, 6)}
    (folder / "in" / "b.mp4").write_bytes(written([picture("b", k) for k in range(5)]))  # lost frames
    with pytest.raises(Exception, match="41 frames were read, 5 are there"):
        run()


def test_videos_and_images_appear_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"{v}.mp4", k, picture(v, k)) for v in "ab" for k in range(60)]
    df = spark.createDataFrame(rows[::-1], "video string, frame long, data binary").repartition(5)
    out = tmp_path / "out"
    frames.write_videos(df, str(out), fps=25.0, stride=3)
    assert sorted(p.name for p in out.iterdir()) == ["a.mp4", "b.mp4"]
    back = spark.read.format("frames").option("path", str(out)).load()
    assert {(r.video, r.frame): bytes(r.data) for r in back.collect()} == {(f"{v}.mp4", k // 3): picture(v, k) for v in "ab" for k in range(0, 60, 3)}
    v = indexed((out / "a.mp4").read_bytes())
    assert (v.width, v.height, round(v.fps, 2)) == (64, 48, 8.33)
    with pytest.raises(Exception, match="files that are there"):
        frames.write_videos(df, str(out))
    frames.write_videos(df.where("frame < 5"), str(out), mode="overwrite")
    assert len(indexed((out / "b.mp4").read_bytes()).size) == 5
    bad = tmp_path / "bad"
    fails = df.withColumn("data", F.when((F.col("video") == "b.mp4") & (F.col("frame") == 30), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        frames.write_videos(fails, str(bad))
    assert not bad.exists() or not list(bad.iterdir())
    mixed = df.repartition(2, "frame").sortWithinPartitions("frame")
    with pytest.raises(Exception, match="not together"):
        mixed.write.format("videos").option("path", str(bad)).mode("append").save()
    images = spark.createDataFrame([(f"{k}.jpg", picture("a", k)) for k in range(9)], "name string, data binary").repartition(3)
    frames.write_images(images, str(tmp_path / "jpg"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "jpg").iterdir()} == {f"{k}.jpg": picture("a", k) for k in range(9)}
    with pytest.raises(Exception, match="not a file name"):
        frames.write_images(images.withColumn("name", F.lit("../x")), str(tmp_path / "jpg"))
