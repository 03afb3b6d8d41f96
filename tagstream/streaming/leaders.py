"""Leader clustering and live tags as streams. A live leader is an entry of its video's map state; event-time timers drop those that
no crop can join any more, so that the state holds what is alive, of videos that go on and of those that have ended."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import Leaders
from ..operators.identity import alive

FPS = 25.0
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeaderState(StatefulProcessor):
    """Map state: leader -> hash, frame and event time of its last crop. Value state: the next leader's number and the last frame.
    Only leaders that a trigger changes are written."""

    def __init__(self, distance: int, gap: int, fps: float):
        self.distance, self.gap, self.fps = distance, gap, fps

    def init(self, handle) -> None:
        self.handle = handle
        self.leaders = handle.getMapState("leaders", "id long", "hash long, frame long, millis long")
        self.head = handle.getValueState("head", "next long, frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh, last = self.head.get() if self.head.exists() else (0, -1)
        pdf = pd.concat(list(rows))
        pdf = pdf[pdf["frame"] > last].sort_values(["frame", "crop_id"], kind="stable")
        if not len(pdf):
            return
        before = {k[0]: tuple(v) for k, v in self.leaders.iterator()}
        live = Leaders(self.distance, self.gap)
        live.restore(fresh, [(k, h, f) for k, (h, f, _) in sorted(before.items())])
        millis = dict(zip(pdf["frame"].tolist(), pdf["millis"].tolist(), strict=True))
        cluster = [live.add(h, int(f)) for h, f in zip(pdf["hash"].to_numpy(np.uint64), pdf["frame"].to_numpy(), strict=True)]
        live.expire(int(pdf["frame"].iloc[-1]))
        now = {k: (h, f, millis[f] if f in millis else before[k][2]) for k, h, f in live.rows()}
        for k in before.keys() - now.keys():
            self.leaders.removeKey((k,))
        for k, v in now.items():
            if before.get(k) != v:
                self.leaders.updateValue((k,), v)
        self.head.update((live.n, int(pdf["frame"].iloc[-1])))
        self.wait({k: v[2] for k, v in now.items()}, timerValues)
        yield pd.DataFrame({"video": key[0], "crop_id": pdf["crop_id"], "cluster": np.array(cluster, np.int64)})

    def ends(self, millis: int) -> int:
        """When a leader that was last seen then can get no crop any more."""
        return millis + int(np.ceil(self.gap * 1000 / self.fps)) + 1

    def wait(self, seen: dict[int, int], timers) -> None:
        """One timer a video: when its oldest leader ends."""
        if seen and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(max(self.ends(min(seen.values())), timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        seen = {k[0]: v[2] for k, v in self.leaders.iterator()}
        for k in [k for k, at in seen.items() if self.ends(at) <= watermark]:
            self.leaders.removeKey((k,))
            del seen[k]
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        self.wait(seen, timerValues)
        return iter(())

    def close(self) -> None:
        pass


def keeps_timers(spark: SparkSession) -> None:
    """The state store that maps and timers need, for the queries that the session starts from now on."""
    spark.conf.set(STORE, ROCKSDB)


def leader_stream(crops: DataFrame, distance: int = 6, gap: int = 150, fps: float = FPS, late: str = "10 seconds") -> DataFrame:
    """video, crop_id, cluster of a stream of video, crop_id, frame, hash, ts: as lead() over each video's crops in frame order.

    ts is when a frame was taken: frames of a video are 1 / fps seconds apart. Crops of frames at or before a video's last one, or behind the watermark, are
    late and dropped; null frames and hashes are, too. Needs keeps_timers(spark).
    """
    rows = crops.where("frame is not null and hash is not null and ts is not null").select("video", "crop_id", "frame", "hash", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late).withColumn("millis", F.unix_millis("ts"))
    return rows.groupBy("video").transformWithStateInPandas(LeaderState(distance, gap, fps), "video long, crop_id long, cluster long", "Append", "EventTime")


def alive_stream(detections: DataFrame) -> DataFrame:
    """video, frame, n, ids: the tags that the nearest-centre tracker holds after each frame, seen in it or not. Rows of frames at or before the last one are late and dropped."""

    def step(key, parts, state: GroupState):
        kept = json.loads(state.get[0]) if state.exists else {"frame": -1, "next": 0, "tags": {}}
        pdf = pd.concat(list(parts))
        pdf = pdf[pdf["frame"] > kept["frame"]].sort_values(["frame", "det_idx"], kind="stable")
        run = {"next": kept["next"], "tags": {int(k): v for k, v in kept["tags"].items()}}
        found = alive(run, pdf) if len(pdf) else pd.DataFrame({"video": [], "frame": [], "n": [], "ids": []})
        last = int(pdf["frame"].max()) if len(pdf) else kept["frame"]
        state.update((json.dumps({"frame": last, "next": run.get("next", 0), "tags": {k: [float(x) for x in v] for k, v in run["tags"].items()}}),))
        yield found

    return detections.groupBy("video").applyInPandasWithState(step, "video long, frame long, n long, ids string", "state string", "append", GroupStateTimeout.NoTimeout)
