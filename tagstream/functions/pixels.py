"""Pixels of image columns (rows of height, width, nChannels, data; blue, green, red): resizing, affine copies, tone, blur."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUBIC = -0.75
#: Kernels of a Gaussian whose spread follows from its size.
BLUR = {3: np.array([1, 2, 1]) / 4, 5: np.array([1, 4, 6, 4, 1]) / 16}


def decoded(data: bytes | None, height: int | None, width: int | None, channels: int | None) -> np.ndarray | None:
    """height x width x 3 bytes; grey images have equal channels, a fourth one goes. None where the bytes don't fit the size."""
    if data is None or not height or not width or not channels or height < 1 or width < 1 or len(data) != height * width * channels or channels == 2:
        return None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., :3]


@lru_cache(maxsize=256)
def cubic(n: int, size: int) -> np.ndarray:
    """Weights (size, n) of a row of n pixels resized to `size`, by cubic convolution between pixel centres; borders are replicated."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    low = np.floor(at).astype(int)
    out = np.zeros((size, n))
    for k in range(-1, 3):
        d = np.abs(at - (low + k))
        near = (CUBIC + 2) * d**3 - (CUBIC + 3) * d**2 + 1
        far = CUBIC * (d**3 - 5 * d**2 + 8 * d - 4)
        np.add.at(out, (np.arange(size), np.clip(low + k, 0, n - 1)), np.where(d <= 1, near, far))
    return out


@lru_cache(maxsize=256)
def linear(n: int, size: int) -> np.ndarray:
    """The same by linear interpolation."""
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(n)[None]))


def resized(img: np.ndarray, rows: int, cols: int, weights=cubic) -> np.ndarray:
    """Bytes again, rounded half to even."""
    if img.shape[:2] == (rows, cols):
        return img
    out = np.tensordot(weights(img.shape[0], rows), img.astype(float), 1)
    out = np.tensordot(weights(img.shape[1], cols), out, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.round(np.round(out, 6)), 0, 255).astype(np.uint8)  # sums differ in their last bits from machine to machine


def turned(img: np.ndarray, degrees: float, scale: float) -> np.ndarray:
    """Turned counter-clockwise about the middle and scaled, by linear interpolation; what lies outside is the nearest border pixel."""
    h, w = img.shape[:2]
    a = np.deg2rad(degrees)
    c, s = np.cos(a) / scale, np.sin(a) / scale
    x, y = np.arange(w)[None] - w / 2, np.arange(h)[:, None] - h / 2
    sx, sy = np.clip(c * x - s * y + w / 2, 0, w - 1), np.clip(s * x + c * y + h / 2, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), max(w - 2, 0)), np.minimum(sy.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    img = img.astype(float)
    top = img[y0, x0] * (1 - fx) + img[y0, x1] * fx
    low = img[y1, x0] * (1 - fx) + img[y1, x1] * fx
    return np.clip(np.round(np.round(top * (1 - fy) + low * fy, 6)), 0, 255).astype(np.uint8)


def toned(img: np.ndarray, brightness: float, contrast: float) -> np.ndarray:
    """Truncated to bytes."""
    return np.clip(img.astype(np.float32) * np.float32(contrast) + np.float32((brightness - 1) * 60), 0, 255).astype(np.uint8)


def blurred(img: np.ndarray, size: int) -> np.ndarray:
    """Gaussian of 3 or 5 pixels each way; borders are mirrored at the last pixel. Other sizes leave the image as it is."""
    if size not in BLUR:
        return img
    out = img.astype(float)
    for axis in (0, 1):
        n, r = img.shape[axis], size // 2
        at = np.abs(np.arange(-r, n + r))
        at = np.where(at >= n, 2 * (n - 1) - at, at) if n > 1 else at * 0
        at = np.clip(at, 0, n - 1)
        out = sum(k * np.take(out, at[i : i + n], axis=axis) for i, k in enumerate(BLUR[size]))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def augmented(img: np.ndarray, rotation: float, scale: float, brightness: float, contrast: float, blur: int) -> np.ndarray:
    return blurred(toned(turned(img, rotation, scale), brightness, contrast), blur)


def augment(images: DataFrame, draws: DataFrame, key: str = "source_crop_id") -> DataFrame:
    """The copies of draws (crop_id, key, rotation, scale, brightness, contrast, blur) from images (key, height, width, nChannels, data):
    crop_id, height, width, nChannels (3), data. Copies of images that are missing or can't be decoded have no row."""
    names = ["crop_id", "height", "width", "nChannels", "data", "rotation", "scale", "brightness", "contrast", "blur"]
    rows = draws.select("crop_id", key, *names[5:]).join(images.select(key, *names[1:5]), key).select(*names)
    out = pa.schema([("crop_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                r = {n: batch[n][k].as_py() for n in names}
                img = decoded(r["data"], r["height"], r["width"], r["nChannels"])
                if img is not None:
                    copy = augmented(img, *(r[n] for n in names[5:]))
                    found.append((r["crop_id"], r["height"], r["width"], 3, copy.tobytes()))
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), out, strict=True)], schema=out) if found else pa.record_batch([pa.array([], t.type) for t in out], schema=out)

    return rows.mapInArrow(run, "crop_id long, height int, width int, nChannels int, data binary")


def prepared(images: DataFrame, size: int, key: str = "crop_id") -> DataFrame:
    """key, x: size x size x 3 bytes, red, green, blue; x is null for images that can't be decoded."""
    rows = images.select(F.col(key).alias("key"), "height", "width", "nChannels", "data")

    def run(batches):
        for batch in batches:
            cols = [batch[n].to_pylist() for n in ("data", "height", "width", "nChannels")]
            found = [decoded(*c) for c in zip(*cols, strict=True)]
            x = [None if i is None else np.ascontiguousarray(resized(i, size, size)[..., ::-1]).tobytes() for i in found]
            yield pa.record_batch([batch["key"].cast(pa.int64()), pa.array(x, pa.binary())], names=["key", "x"])

    return rows.mapInArrow(run, "key long, x binary").withColumnRenamed("key", key)
