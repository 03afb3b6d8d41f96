"""Frames of videos as data sources: "frames" reads them, in batch and as a stream; "videos" and "images" write files that appear whole or not at all.

    spark.dataSource.register(FrameSource)
    spark.readStream.format("frames").option("path", folder).load()

Frames are the container's samples, encoded as they are. A video ends at its first frame that can't be read. The planner reads
indexes alone; a task reads the bytes of its own frames.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .container import Damaged, Video, place, read_index, readable, write_container

FRAMES = "video string, frame long, seconds double, data binary"
#: Frames of a task, and bytes of a batch on its way from it.
PER_TASK, BATCH = 256, 8 << 20


@dataclass
class Known:
    """What the planner has read of a file, as long as its size and time stay."""

    stamp: tuple[int, object]
    video: Video | None = None
    frames: int = 0


@dataclass
class FramesOf(InputPartition):
    path: str
    name: str
    first: int
    places: list[tuple[int, int, float]] = field(default_factory=list)


class Folder:
    """The videos of a folder, and how many of their frames can be read by now."""

    def __init__(self, options):
        self.path, self.per_task = options["path"], int(options.get("framesPerTask", PER_TASK))
        self.suffix = options.get("suffix", ".mp4")
        self.known: dict[str, Known] = {}

    def files(self) -> Iterator[tuple[str, fs.FileInfo]]:
        system, at = place(self.path)
        for info in system.get_file_info(fs.FileSelector(at)):
            if info.type == fs.FileType.File and info.base_name.endswith(self.suffix) and not info.base_name.startswith((".", "_")):
                yield info.base_name, info

    def look(self) -> dict[str, int]:
        """Frames of each video that can be read; of files that are as they were, nothing is read again."""
        system, _ = place(self.path)
        for name, info in self.files():
            stamp, before = (info.size, info.mtime_ns), self.known.get(name)
            if before and before.stamp == stamp:
                continue
            now = Known(stamp)
            try:
                with system.open_input_file(info.path) as f:
                    now.video = read_index(f, info.size)
                    now.frames = readable(f, info.size, now.video)
            except (Damaged, OSError):  # not finished yet, or no video: no frames
                pass
            self.known[name] = now
        return {name: k.frames for name, k in sorted(self.known.items())}

    def parts(self, start: dict[str, int], end: dict[str, int]) -> list[FramesOf]:
        found = []
        for name, last in sorted(end.items()):
            first = start.get(name, 0)
            if first > last:
                raise ValueError(f"{name}: {first} frames were read, {last} are there")
            if first == last:
                continue
            if name not in self.known or self.known[name].frames < last:
                self.look()
            known = self.known.get(name)
            if known is None or known.frames < last:
                raise ValueError(f"{name}: frames up to {last} were there, now {known.frames if known else 0} are")
            v = known.video
            for k in range(first, last, self.per_task):
                z = min(k + self.per_task, last)
                places = list(zip(v.offset[k:z].tolist(), v.size[k:z].tolist(), (v.time[k:z] / v.scale).tolist(), strict=True))
                found.append(FramesOf(f"{self.path.rstrip('/')}/{name}", name, k, places))
        return found


def frames_of(part: FramesOf) -> Iterator[pa.RecordBatch]:
    """The frames of a part, in batches of bounded bytes."""
    schema = pa.schema([("video", pa.string()), ("frame", pa.int64()), ("seconds", pa.float64()), ("data", pa.binary())])
    system, at = place(part.path)
    with system.open_input_file(at) as f:
        rows, held = [], 0
        for k, (offset, size, seconds) in enumerate(part.places):
            f.seek(offset)
            data = f.read(size)
            if len(data) < size:
                raise Damaged(f"{part.path}: frame {part.first + k} was there when planned")
            rows.append((part.name, part.first + k, seconds, data))
            held += size
            if held >= BATCH or k + 1 == len(part.places):
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.folder = Folder(options)

    def partitions(self):
        return self.folder.parts({}, self.folder.look()) or [FramesOf("", "", 0)]

    def read(self, partition):
        return frames_of(partition) if partition.places else iter(())


class FrameStream(DataSourceStreamReader):
    """Offsets are the numbers of frames read of each video: a restart goes on behind the last frame of each. A video that grows, or is
    written anew with more frames, goes on, too; new files are new videos. A file that lost frames which were read is an error."""

    def __init__(self, options):
        self.folder = Folder(options)

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        return self.folder.look()

    def partitions(self, start, end):
        return self.folder.parts(start, end)

    def read(self, partition):
        return frames_of(partition)


class FrameSource(DataSource):
    """Options: path, suffix (.mp4), framesPerTask."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return FrameReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return FrameStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceWriter):
    """Tasks write whole files into a hidden folder of the job; commit moves them to their names, abort deletes the folder. A file of two tasks is an error."""

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.path = options["path"].rstrip("/")
        self.job = f"{self.path}/.job-{uuid.uuid4().hex}"

    def files(self, rows, create) -> Iterator[str]:
        """Write all rows with create(name) -> (final name, open stream), and yield the names."""
        raise NotImplementedError

    def write(self, iterator):
        own = f"{self.job}/{uuid.uuid4().hex}"
        system, at = place(own)
        system.create_dir(at)
        return Written([f"{own}/{name}" for name in self.files(iterator, lambda name: system.open_output_stream(f"{at}/{checked(name)}"))])

    def commit(self, messages):
        found = [name for m in messages if m for name in m.names]
        ends = [name.rsplit("/", 1)[1] for name in found]
        twice = {n for n in ends if ends.count(n) > 1} if len(set(ends)) < len(ends) else set()
        system, at = place(self.path)
        there = [] if self.overwrite else [n for n in ends if system.get_file_info(f"{at}/{n}").type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files of several tasks: {sorted(twice)[:5]}; files that are there: {there[:5]}")
        for source, name in zip(found, ends, strict=True):
            system.move(place(source)[1], f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages):
        system, at = place(self.job)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


def checked(name: str) -> str:
    if not name or "/" in name or name.startswith((".", "_")):
        raise ValueError(f"not a file name: {name!r}")
    return name


def jpeg_size(data: bytes) -> tuple[int, int]:
    """Width and height of a JPEG; 0, 0 where it has no frame header."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return 0, 0


class VideoWriter(FileWriter):
    """Rows (video, frame, data) to a container a video. A task's rows come by video, then frame (write_videos sorts them); others are an error."""

    def files(self, rows, create):
        fps, name, frame, ready = float(self.options.get("fps", 25)), None, None, iter(rows)
        row = next(ready, None)
        seen = set()
        while row is not None:
            name, first = row.video, row
            if name in seen:
                raise ValueError(f"rows of {name} are not together")
            seen.add(name)

            def own(name=name):
                nonlocal row, frame
                frame = None
                while row is not None and row.video == name:
                    if frame is not None and row.frame <= frame:
                        raise ValueError(f"{name}: frame {row.frame} after {frame}")
                    frame = row.frame
                    yield bytes(row.data)
                    row = next(ready, None)

            size = jpeg_size(bytes(first.data))
            with create(name) as out:
                write_container(out, own(), *size, fps)
            yield name


class VideoSink(DataSource):
    """Options: path, fps."""

    @classmethod
    def name(cls):
        return "videos"

    def writer(self, schema, overwrite):
        return VideoWriter(self.options, overwrite)


class ImageWriter(FileWriter):
    def files(self, rows, create):
        for row in rows:
            with create(row.name) as out:
                out.write(bytes(row.data))
            yield row.name


class ImageSink(DataSource):
    """Rows (name, data), a file each. Options: path."""

    @classmethod
    def name(cls):
        return "images"

    def writer(self, schema, overwrite):
        return ImageWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (FrameSource, VideoSink, ImageSink):
        spark.dataSource.register(source)


def write_videos(frames: DataFrame, path: str, fps: float = 25.0, stride: int = 1, mode: str = "append") -> None:
    """A file for each video of (video, frame, data), of every stride-th frame at fps / stride. A video streams through one task; it holds a media box of frames and the sizes."""
    register(frames.sparkSession)
    rows = frames.where(F.col("frame") % stride == 0).select("video", "frame", "data").repartition("video").sortWithinPartitions("video", "frame")
    rows.write.format("videos").option("path", path).option("fps", fps / stride).mode(mode).save()


def write_images(images: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each row of (name, data)."""
    register(images.sparkSession)
    images.select("name", "data").write.format("images").option("path", path).mode(mode).save()
