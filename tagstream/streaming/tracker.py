"""The nearest-centroid tracker on a stream of per-frame detections, one state a video."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.identity import follow, frames

OUT = "video long, frame long, det_idx long, track_id long"


def track_stream(detections: DataFrame) -> DataFrame:
    """Rows of frames at or before the last one seen are late and dropped; the state holds live tags only."""

    def step(key, parts, state: GroupState):
        kept = json.loads(state.get[0]) if state.exists else {"frame": -1, "next": 0, "tags": {}}
        pdf = pd.concat(list(parts))
        pdf = pdf[pdf["frame"] > kept["frame"]].sort_values(["frame", "det_idx"], kind="stable")
        run = {"next": kept["next"], "tags": {int(k): v for k, v in kept["tags"].items()}}
        ids = [i for _, boxes in frames(pdf) for i in follow(run, boxes)]
        last = int(pdf["frame"].max()) if len(pdf) else kept["frame"]
        state.update((json.dumps({"frame": last, "next": run.get("next", 0), "tags": {k: [float(x) for x in v] for k, v in run["tags"].items()}}),))
        yield pd.DataFrame({"video": pdf["video"], "frame": pdf["frame"], "det_idx": pdf["det_idx"], "track_id": pd.Series(ids, index=pdf.index, dtype="int64")})

    return detections.groupBy("video").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def tag_counts(detections: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Detections per class and event-time window; ts is cast, as watermarks need zoned timestamps."""
    from pyspark.sql import functions as F

    return detections.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", window), "cls").agg(F.count("*").alias("n"))
