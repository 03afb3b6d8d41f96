"""Identity of tracks from repeated tag reads, as a fold over one video's reads in frame order: a batch form and a stream."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import STREAK

RECENT = 30
OUT = "type string, frame long, code string, track_id long, old_code string, tracks array<long>"


def reconcile(state: dict, rows) -> list[tuple]:
    """Events of (frame, track_id, code) rows. state: track -> [code, pending, times, reads ago].

    STREAK equal reads in a row that differ from a track's code give it that code; other tracks that hold it and were
    read under RECENT of their own rows ago make it a possible swap.
    """
    events = []
    for frame, track, code in rows:
        own = state.setdefault(track, [None, None, 0, 0])
        if code is None:
            own[1:] = [None, 0, own[3] + 1]
            continue
        own[3] = 0
        if code == own[0]:
            own[1:3] = [None, 0]
        elif code != own[1]:
            own[1:3] = [code, 1]
        else:
            own[2] += 1
            if own[2] >= STREAK:
                holders = sorted(t for t, s in state.items() if t != track and s[0] == code and s[3] < RECENT)
                if holders:
                    events.append(("possible_swap", frame, code, track, None, [track, *holders]))
                events.append(("identity_reassigned", frame, code, track, own[0], None))
                own[:3] = [code, None, 0]
    return events


def reconcile_stream(reads: DataFrame, video: str = "video") -> DataFrame:
    """Events of a stream of video, frame, track_id, code. Rows at or before the last frame seen are late and dropped; the state has a row a track."""

    def step(key, parts, state: GroupState):
        kept = json.loads(state.get[0]) if state.exists else {"frame": -1, "tracks": {}}
        pdf = pd.concat(list(parts))
        pdf = pdf[pdf["frame"] > kept["frame"]].sort_values(["frame", "track_id"], kind="stable")
        tracks = {int(k): v for k, v in kept["tracks"].items()}
        rows = [(int(f), int(t), None if pd.isna(c) else c) for f, t, c in zip(pdf["frame"], pdf["track_id"], pdf["code"], strict=True)]
        events = reconcile(tracks, rows)
        state.update((json.dumps({"frame": int(pdf["frame"].max()) if len(pdf) else kept["frame"], "tracks": tracks}),))
        yield pd.DataFrame(events, columns=["type", "frame", "code", "track_id", "old_code", "tracks"])

    return reads.withColumn("key_", F.col(video)).groupBy("key_").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)
