"""Hashes of decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, COLS = 8, 9


def shrunk(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over the areas of a coarser grid; a pixel that lies in two cells counts in both by its part."""

    def parts(n: int, k: int) -> np.ndarray:
        edge = np.arange(k + 1) * n / k
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * k / n

    return parts(gray.shape[0], rows) @ gray @ parts(gray.shape[1], cols).T


def dhash_of(data: bytes, height: int, width: int, channels: int) -> int:
    """64 comparisons of neighbours of a 9 by 8 grey image, row by row, the first one lowest; the last bit makes the number negative."""
    pixels = np.frombuffer(data, np.uint8)
    if height <= 0 or width <= 0 or len(pixels) != height * width * channels:
        return 0
    x = pixels.reshape(height, width, channels).astype(float)
    gray = np.round(x[..., :3] @ [0.114, 0.587, 0.299]) if channels >= 3 else x[..., 0]
    small = np.round(shrunk(gray, ROWS, COLS))
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@F.pandas_udf("long")
def dhash(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, height, width, channels in parts:
        yield pd.Series([dhash_of(d, h, w, c) if d is not None else 0 for d, h, w, c in zip(data, height, width, channels, strict=True)], dtype="int64")


def hashed(images: DataFrame) -> DataFrame:
    """origin, hash of decoded images (blue, green, red); undecodable ones have hash 0."""
    return images.select("origin", dhash("data", "height", "width", "nChannels").alias("hash"))
