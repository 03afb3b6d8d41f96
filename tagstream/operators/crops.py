"""Crops of frames and sheets of crops: pixels behind the padded boxes and the grid positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import decoded, linear, resized

PAD, LEAST_SIDE = 0.15, 160
#: A sheet: cells, margins left of and above a thumbnail, and what a cell leaves free in all.
COLUMNS, CELL, MARGIN, FREE = 6, (200, 220), 5, (40, 10)
IMAGE = "height int, width int, nChannels int, data binary"


def padded(x1: float, y1: float, x2: float, y2: float, pad: float, width: int, height: int) -> tuple[int, int, int, int]:
    """As crop_padded: truncated, inside the image."""
    w, h = (x2 - x1) * pad, (y2 - y1) * pad
    return max(0, int(x1 - w)), max(0, int(y1 - h)), min(width, int(x2 + w)), min(height, int(y2 + h))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def cropped(images: DataFrame, boxes: DataFrame, pad: float = PAD) -> DataFrame:
    """video, frame, det_idx, x0, y0 (the crop's place), height, width, nChannels (3), data of every box (video, frame, det_idx, x1, y1, x2, y2) of an
    image (video, frame, height, width, nChannels, data). Boxes whose crop is empty, with a null corner, or of images that can't be decoded have no row. An image goes to its boxes once."""
    out = pa.schema([("video", pa.int64()), ("frame", pa.int64()), ("det_idx", pa.int64()), ("x0", pa.int32()), ("y0", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])
    corners = ("x1", "y1", "x2", "y2")
    per = boxes.dropna(subset=list(corners)).groupBy("video", "frame").agg(F.array_sort(F.collect_list(F.struct("det_idx", *corners))).alias("boxes"))  # a frame's boxes
    rows = images.select("video", "frame", "height", "width", "nChannels", "data").join(per, ["video", "frame"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch[n][k].as_py() for n in batch.schema.names}
                img = decoded(r["data"], r["height"], r["width"], r["nChannels"])
                found = []
                for b in r["boxes"] if img is not None else ():
                    x0, y0, x1, y1 = padded(*(b[c] for c in corners), pad, r["width"], r["height"])
                    if x1 > x0 and y1 > y0:
                        found.append((r["video"], r["frame"], b["det_idx"], x0, y0, y1 - y0, x1 - x0, 3, np.ascontiguousarray(img[y0:y1, x0:x1]).tobytes()))
                yield batch_of(found, out)

    return rows.mapInArrow(run, "video long, frame long, det_idx long, x0 int, y0 int, " + IMAGE)


def enlarged(img: np.ndarray, least: int = LEAST_SIDE) -> np.ndarray:
    """By the whole number that brings its height near `least`, 1 at least."""
    by = max(1, least // max(img.shape[0], 1))
    return resized(img, img.shape[0] * by, img.shape[1] * by)


def thumbnail(img: np.ndarray) -> np.ndarray:
    by = min((CELL[1] - FREE[1]) / img.shape[1], (CELL[0] - FREE[0]) / img.shape[0])
    return resized(img, max(1, int(img.shape[0] * by)), max(1, int(img.shape[1] * by)), linear)


def contact_sheets(crops: DataFrame, per_sheet: int = 60, columns: int = COLUMNS) -> DataFrame:
    """sheet, height, width, nChannels (3), data of white sheets with per_sheet crops each (place, height, width, nChannels, data): the crop of place i is in cell i % per_sheet,
    row by row. Crops that can't be decoded leave their cell white; a sheet is as high as its last cell."""
    out = pa.schema([("sheet", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])

    def draw(key, table):
        rows = table.select(["place", "height", "width", "nChannels", "data"]).to_pylist()
        at = [r["place"] % per_sheet for r in rows]
        sheet = np.full(((max(at) // columns + 1) * CELL[0], columns * CELL[1], 3), 255, np.uint8)
        for i, r in zip(at, rows, strict=True):
            img = decoded(r["data"], r["height"], r["width"], r["nChannels"])
            if img is not None:
                small = thumbnail(img)
                y, x = i // columns * CELL[0] + MARGIN, i % columns * CELL[1] + MARGIN
                sheet[y : y + small.shape[0], x : x + small.shape[1]] = small
        return pa.Table.from_batches([batch_of([(key[0].as_py(), *sheet.shape, sheet.tobytes())], out)])

    rows = crops.select("place", "height", "width", "nChannels", "data").withColumn("sheet", F.floor(F.col("place") / per_sheet))
    return rows.groupBy("sheet").applyInArrow(draw, "sheet long, " + IMAGE)
