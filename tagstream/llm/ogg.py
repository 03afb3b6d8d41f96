"""Media columns: a text's bytes as 8-bit samples in an Ogg container, written and read back.

write_ogg(df): media binary per row. Two logical streams are multiplexed: serial 1 holds a
head packet and frames of 576 samples, serial 2 one packet that names the text's unpadded length.
read_ogg(df): verifies every page's checksum, demultiplexes by serial number, reassembles
packets from lacing values and derives each packet's time from the granule positions: a page's is that of the last packet
that ends on it, and those before it count back by their samples.

Cases: null text is empty text; empty text is one frame of byte 255; equal texts give equal
media; a null media value reads as no streams (all result columns null); damaged media, and media without the two
streams, have the reason in column error and null in the others.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, schema

FRAME, RATE = 576, 8000
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = "<4sBBqIII"
_PER_PAGE = 255 // (FRAME // 255 + 1)


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 04C11DB7, most significant bit first, from 0. zlib's is its mirror image."""
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def page(packets_lacing: bytes, body: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    head = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(packets_lacing)]) + packets_lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]


def lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def padded(raw: bytes) -> bytes:
    """At least one frame; the last one filled with byte 255."""
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def encode(raw: bytes) -> bytes:
    payload = padded(raw)
    head = b"\x01samples8" + struct.pack("<IH", RATE, FRAME)
    note = b"\x02length" + struct.pack("<Q", len(raw))
    out = [page(lacing(len(head)), head, 2, 0, 1, 0), page(lacing(len(note)), note, 2 | 4, 0, 2, 0)]
    step, one = _PER_PAGE * FRAME, lacing(FRAME)
    for k, at in enumerate(range(0, len(payload), step)):
        body = payload[at : at + step]
        last = at + step >= len(payload)
        out.append(page(one * (len(body) // FRAME), body, 4 * last, at + len(body), 1, k + 1))
    return b"".join(out)


def streams(media: bytes) -> dict[int, dict]:
    """serial -> packets (bytes), granules (of the page each packet ends on), pages (number of the page each ends on)."""
    found: dict[int, dict] = {}
    at, n = 0, len(media)
    while at < n:
        if at + 27 > n or at + 27 + media[at + 26] > n:
            raise ValueError("the last page is cut off")
        mark, version, flags, granule, serial, number, crc = struct.unpack_from(_HEAD, media, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no Ogg page at byte {at}")
        count = media[at + 26]
        laces = media[at + 27 : at + 27 + count]
        start = at + 27 + count
        end = start + sum(laces)
        if end > n:
            raise ValueError("the last page is cut off")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        s = found.setdefault(serial, {"packets": [], "granules": [], "pages": [], "open": b"", "next": 0, "ended": False})
        if number != s["next"] or s["ended"] or bool(flags & 2) != (number == 0):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        if bool(flags & 1) != bool(s["open"]):
            raise ValueError(f"page {number} of stream {serial} does not continue the packet before it")
        s["next"], s["ended"] = number + 1, bool(flags & 4)
        size = 0
        for x in laces:
            size += x
            if x < 255:
                s["packets"].append(s["open"] + media[start : start + size])
                s["granules"].append(granule)
                s["pages"].append(number)
                s["open"], start, size = b"", start + size, 0
        s["open"] += media[start : start + size]
        at = end
    if any(s["open"] or not s["ended"] for s in found.values()):
        raise ValueError("a stream does not end")
    return found


def packet_ends(stream: dict, samples: list[int]) -> list[int]:
    """End of each packet in samples, from the granule of the page that it ends on."""
    ends, later, page = [], 0, None
    for granule, number, n in zip(reversed(stream["granules"]), reversed(stream["pages"]), reversed(samples), strict=True):
        later = 0 if number != page else later
        ends.append(granule - later)
        later, page = later + n, number
    return ends[::-1]


def read_back(media: bytes) -> dict:
    found = streams(media)
    if 1 not in found or 2 not in found or len(found[1]["packets"][0]) < 15 or len(found[2]["packets"][0]) < 15:
        raise ValueError("no sample stream with a length stream beside it")
    head, frames = found[1]["packets"][0], found[1]["packets"][1:]
    rate, _ = struct.unpack_from("<IH", head, 9)
    if not rate or not frames:
        raise ValueError("no samples")
    payload = b"".join(frames)
    ends = packet_ends(found[1], [0, *map(len, frames)])[1:]
    if ends != np.cumsum([len(f) for f in frames]).tolist():
        raise ValueError("the granule positions are not those of the samples")
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    stats = (int(centred.sum()), int((centred * centred).sum()), int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0))), int(x.min()), int(x.max()))
    times = [e * 1_000_000 // rate for e in ends]
    return {
        "n_bytes": struct.unpack_from("<Q", found[2]["packets"][0], 7)[0], "payload": payload, "frames": len(frames), "packet_us": times, "end_us": times[-1],
        "feature": f"frames={len(frames)};end_us={times[-1]};sum={stats[0]};energy={stats[1]};crossings={stats[2]};min={stats[3]};max={stats[4]}",
    }


def tried(media: bytes) -> dict:
    try:
        return read_back(media)
    except (ValueError, struct.error) as e:
        return {"error": str(e)}


def write_ogg(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media (binary)."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        return lambda c: [c[0], [encode((t or "").encode("utf-8", "surrogatepass")) for t in c[1]]]

    return map_rows(df.select(F.col(key), F.col(text)), make, schema(f"{key} {kind}, media binary"))


def read_ogg(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, n_bytes, payload, frames, packet_us (end of each frame), end_us, feature, digests of the payload and the stored form, and error."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        def f(c):
            rows = [{} if m is None else tried(m) for m in c[1]]
            of = lambda name, g=lambda x: x: [g(r[name]) if name in r else None for r in rows]
            stored = lambda g: [g(m) if "payload" in r else None for r, m in zip(rows, c[1], strict=True)]
            return [
                c[0], of("n_bytes"), of("payload"), of("frames"), of("packet_us"), of("end_us"),
                of("payload", len), of("payload", lambda p: hashlib.sha256(p).hexdigest()), of("payload", lambda p: zlib.crc32(p[-32:])),
                stored(len), stored(lambda m: hashlib.sha256(m).hexdigest()), of("feature"), of("error"),
            ]

        return f

    out = f"{key} {kind}, n_bytes long, payload binary, frames long, packet_us array<long>, end_us long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return map_rows(df.select(key, media), make, schema(out))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_ogg(write_ogg(documents(spark, sf_dir)))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
