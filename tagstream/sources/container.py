"""Video containers of nested length-prefixed boxes: what they hold, where each frame lies, and how they are written.

Only the index is read: box headers, and the movie box with its tables. Files are opened by ranges where Arrow's file systems
know the path's scheme; others come whole from Spark's binaryFile source.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.media import probe

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
#: The largest box that is read into memory: an index of some 10^7 frames.
MOST_INDEX = 1 << 28
INDEX = "path string, bytes long, width int, height int, fps double, frame_count long, code long, readable long, error string"
#: Bytes of frames in one media box of a written file.
CHUNK = 8 << 20


class Damaged(ValueError):
    """What is wrong with a container."""


@dataclass
class Video:
    width: int
    height: int
    code: bytes
    scale: int
    size: np.ndarray  # bytes of each frame
    offset: np.ndarray  # its place in the file
    time: np.ndarray  # its start, in units of 1 / scale seconds
    length: int  # of all frames, in the same units

    @property
    def fps(self) -> float:
        return len(self.size) * self.scale / self.length if self.length else 0.0


def boxes(f, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """kind, start and end of the contents of each box between two places of a file."""
    while start < end:
        f.seek(start)
        head = f.read(16)
        if len(head) < 8:
            raise Damaged(f"cut in the header of a box at {start}")
        size, kind = struct.unpack(">I4s", head[:8])
        skip = 8
        if size == 1:
            if len(head) < 16:
                raise Damaged(f"cut in the header of a box at {start}")
            size, skip = struct.unpack(">Q", head[8:])[0], 16
        elif size == 0:
            size = end - start
        if size < skip:
            raise Damaged(f"box {kind.decode('latin-1')} at {start} is {size} bytes long")
        if start + size > end and kind != b"mdat":  # frames may be cut: those before are there
            raise Damaged(f"box {kind.decode('latin-1')} at {start} ends at {start + size} of {end}")
        yield kind, start + skip, min(end, start + size)
        start += size


def tables(f, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], bytes]]:
    """The boxes without boxes in them, with the names above and their contents."""
    for kind, a, z in boxes(f, start, end):
        if kind in NESTED:
            yield (*path, kind), b""
            yield from tables(f, a, z, (*path, kind))
        else:
            f.seek(a)
            yield (*path, kind), f.read(z - a)


def numbers(raw: bytes, at: int, count: int, kind: str) -> np.ndarray:
    """count big-endian numbers of a table."""
    width = np.dtype(kind).itemsize
    if at + count * width > len(raw):
        raise Damaged(f"a table of {count} entries has {len(raw)} bytes")
    return np.frombuffer(raw, kind, count, at).astype(np.int64)


def track(found: dict[bytes, bytes], kind: bytes) -> Video:
    """A track from its tables."""
    for name in (b"tkhd", b"mdhd", b"stsd", b"stsz", b"stsc", b"stts"):
        if name not in found:
            raise Damaged(f"no box {name.decode()}")
    try:
        long_head = found[b"mdhd"][0] == 1
        scale, length = struct.unpack(">IQ" if long_head else ">II", found[b"mdhd"][20:32] if long_head else found[b"mdhd"][12:20])
        width, height = (x >> 16 for x in struct.unpack(">II", found[b"tkhd"][-8:]))
        same, n = struct.unpack(">II", found[b"stsz"][4:12])
        counts = {name: struct.unpack(">I", found[name][4:8])[0] for name in (b"stsc", b"stts")}
    except (struct.error, IndexError) as e:
        raise Damaged(f"short table: {e}") from e
    if same and n * 8 > MOST_INDEX:
        raise Damaged(f"{n} frames")
    size = np.full(n, same) if same else numbers(found[b"stsz"], 12, n, ">u4")
    places = b"co64" if b"co64" in found else b"stco"
    if places not in found:
        raise Damaged("no box stco")
    chunk = numbers(found[places], 8, struct.unpack(">I", found[places][4:8])[0], ">u8" if places == b"co64" else ">u4")
    first, per, _ = numbers(found[b"stsc"], 8, 3 * counts[b"stsc"], ">u4").reshape(-1, 3).T
    if len(first) and (first[0] != 1 or (np.diff(first) <= 0).any()):
        raise Damaged("chunks are out of order")
    in_chunk = np.repeat(per, np.diff(np.append(first, len(chunk) + 1)).clip(0))[: len(chunk)]
    if in_chunk.sum() != n:
        raise Damaged(f"{n} frames, but {in_chunk.sum()} in chunks")
    of = np.repeat(np.arange(len(chunk)), in_chunk)
    before = np.cumsum(size) - size
    offset = chunk[of] + before - before[np.repeat(np.cumsum(in_chunk) - in_chunk, in_chunk)] if n else size
    times, delta = numbers(found[b"stts"], 8, 2 * counts[b"stts"], ">u4").reshape(-1, 2).T
    if times.sum() != n:
        raise Damaged(f"{n} frames, but times of {times.sum()}")
    delta = np.repeat(delta, times)
    return Video(width, height, kind, scale, size, offset, np.cumsum(delta) - delta, length or int(delta.sum()))


def read_index(f, length: int) -> Video:
    """The first video track of a file."""
    movie = None
    for kind, a, z in boxes(f, 0, length):
        if kind == b"moov":
            movie = a, z
    if movie is None:
        raise Damaged("no movie box")
    if movie[1] - movie[0] > MOST_INDEX:
        raise Damaged("index too large")
    f.seek(movie[0])
    raw = f.read(movie[1] - movie[0])
    found: list[dict[bytes, bytes]] = []
    for path, content in tables(io.BytesIO(raw), 0, len(raw)):
        if path == (b"trak",):
            found.append({})
        elif path[0] == b"trak":
            found[-1].setdefault(path[-1], content)
    for own in found:
        if own.get(b"hdlr", b"")[8:12] == b"vide":
            return track(own, own.get(b"stsd", b"")[12:16])
    raise Damaged("no video track")


def readable(f, length: int, video: Video, start: int = 0, end: int | None = None) -> int:
    """The first frame from start on that can't be read (end if all can): it is not whole in the file, or a JPEG without its marks."""
    end = len(video.size) if end is None else min(end, len(video.size))
    bad = np.flatnonzero((video.offset[start:end] < 0) | (video.offset[start:end] > length - video.size[start:end]))
    end = start + int(bad[0]) if len(bad) else end
    if video.code == b"jpeg":
        for k in range(start, end):
            f.seek(int(video.offset[k]))
            head = f.read(2)
            f.seek(int(video.offset[k] + video.size[k]) - 2)
            if video.size[k] < 4 or head != b"\xff\xd8" or f.read(2) != b"\xff\xd9":
                return k
    return max(start, end)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark spells it (file:/a), and the path there."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def by_ranges(path: str) -> bool:
    try:
        place(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def probe_files(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """INDEX of every file; error says why a file can't be read, its other columns are then null. readable is the number of frames before the first that can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    ranged = by_ranges(path)

    def rows(batches):
        for batch in batches:
            cols = batch.to_pydict()
            out = []
            for k, (name, length) in enumerate(zip(cols["path"], cols["length"], strict=True)):
                try:
                    system, at = place(name) if ranged else (None, "")
                    with system.open_input_file(at) if ranged else io.BytesIO(cols["content"][k]) as f:
                        v = read_index(f, length)
                        out.append((name, length, v.width, v.height, v.fps, len(v.size), int.from_bytes(v.code, "little"), readable(f, length, v), None))
                except (Damaged, OSError) as e:
                    out.append((name, length, None, None, None, None, None, None, str(e)))
            names = [x.split()[0] for x in INDEX.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
            yield pa.record_batch([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*out, strict=True), INDEX.split(", "), strict=True)], names=names) if out else pa.record_batch([pa.array([], kinds[x.split()[1]]) for x in INDEX.split(", ")], names=names)

    return (files.select("path", "length") if ranged else files.select("path", "length", "content")).mapInArrow(rows, INDEX)


def probe_videos(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """What a probe reports of each file that can be read; file is its name."""
    found = probe_files(spark, path, pattern).where("error is null")
    return probe(found.withColumn("file", F.substring_index("path", "/", -1)))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def packed(*columns: Iterable[int], kind: str = ">u4") -> bytes:
    """A table's number of entries, and its entries."""
    table = np.array([list(c) for c in columns], kind).T
    return struct.pack(">I", len(table)) + table.tobytes()


def write_container(out, frames: Iterable[bytes], width: int, height: int, fps: float, code: bytes = b"jpeg") -> int:
    """Frames in order, then the index; what is held is a media box and the sizes. Returns the number of frames."""
    scale, step = 90000, round(90000 / fps)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    out.write(head)
    at, sizes, chunks, held = len(head), [], [], []

    def flush():
        nonlocal at
        if held:
            body = b"".join(held)
            long_size = len(body) + 8 >= 1 << 32
            out.write((struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) if long_size else struct.pack(">I4s", len(body) + 8, b"mdat")) + body)
            chunks.append((at + (16 if long_size else 8), len(held)))
            at += len(body) + (16 if long_size else 8)
            held.clear()

    total = 0
    for frame in frames:
        held.append(frame)
        sizes.append(len(frame))
        total += len(frame)
        if total >= CHUNK:
            flush()
            total = 0
    flush()
    n, zero = len(sizes), struct.pack(">I", 0)
    unit = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(code, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", width, height, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    table = box(
        b"stbl", box(b"stsd", zero, struct.pack(">I", 1), entry), box(b"stts", zero, packed([n] if n else [], [step] if n else [])),
        box(b"stsc", zero, packed(range(1, len(chunks) + 1), [k for _, k in chunks], [1] * len(chunks))), box(b"stsz", zero, zero, packed(sizes)), box(b"co64", zero, packed([a for a, _ in chunks], kind=">u8")),
    )
    media = box(b"mdia", box(b"mdhd", zero, struct.pack(">IIIIHH", 0, 0, scale, n * step, 0x55C4, 0)), box(b"hdlr", zero, zero, b"vide", bytes(12), b"\0"), box(b"minf", box(b"vmhd", struct.pack(">I", 1), bytes(8)), table))
    head = box(b"tkhd", struct.pack(">6I", 7, 0, 0, 1, 0, n * step), bytes(16), unit, struct.pack(">II", width << 16, height << 16))
    out.write(box(b"moov", box(b"mvhd", zero, struct.pack(">IIII", 0, 0, scale, n * step), struct.pack(">IH", 0x10000, 0x100), bytes(10), unit, bytes(24), struct.pack(">I", 2)), box(b"trak", head, media)))
    return n
