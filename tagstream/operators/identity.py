"""Order-dependent identity folds, one group a video: nearest-centroid ids and associated tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import adapter, frame
from .association import Association, Associations

REACH, MISSES = 400.0, 15
MAX_AGE, LEAST_OVERLAP = 150, 0.2
CONFIGS = [(30, 0.3), (60, 0.3), (90, 0.3), (125, 0.2), (150, 0.3), (200, 0.2), (200, 0.1)]
#: Parts of the configurations: more use more cores, and more time of each. Partitions over which a part's videos are dealt.
PARTS, PLACES = 2, 128


def follow(state: dict, boxes: np.ndarray, reach: float = REACH, misses: int = MISSES) -> list[int]:
    """Ids of one frame's boxes; state (next, tags: id -> [x, y, missed]) moves on. Pairs go by distance, age of id, ordinal."""
    xy = (boxes[:, :2] + boxes[:, 2:4]) / 2
    tags = state.setdefault("tags", {})
    names, ids = list(tags), [-1] * len(xy)
    used: set[int] = set()
    if names:
        at = np.array([tags[t][:2] for t in names])
        dist = np.hypot(xy[None, :, 0] - at[:, None, 0], xy[None, :, 1] - at[:, None, 1])
        near = np.argwhere(dist <= reach)
        order = np.argsort(dist[near[:, 0], near[:, 1]], kind="stable")  # of equal ones, the older id and the smaller ordinal first
        for i, j in near[order].tolist():
            if i not in used and ids[j] < 0:
                used.add(i)
                ids[j] = names[i]
                tags[names[i]] = [*xy[j].tolist(), 0]
    for i, t in enumerate(names):
        if i not in used:
            tags[t][2] += 1
            if tags[t][2] > misses:
                del tags[t]
    for j in range(len(xy)):
        if ids[j] < 0:
            ids[j] = state.get("next", 0)
            state["next"] = ids[j] + 1
            tags[ids[j]] = [*xy[j].tolist(), 0]
    return ids


def frames(pdf: pd.DataFrame):
    """(frame, boxes) of rows that are sorted by frame."""
    at, boxes = pdf["frame"].to_numpy(), pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(pdf)]
    for a, z in zip(cuts, cuts[1:]):  # noqa: B905
        if z > a:
            yield int(at[a]), boxes[a:z]


def ended(batches):
    """(batch, whether it is the end); the end has no rows of its own."""
    for pdf in batches:
        yield pdf, False
    yield None, True


def folded(df: DataFrame, keys: list[str], step, schema: str, places: int | None = None) -> DataFrame:
    """step(state, rows of whole frames) -> rows, for each key in frame order. A task streams its sorted rows in batches: what it holds is a batch and the state.
    places: partitions, which Spark leaves apart then, as few rows may be much work."""

    def run(batches):
        kept, state, now = None, {}, None
        for pdf, last in ended(batches):
            pdf = pdf if kept is None else kept if pdf is None else pd.concat([kept, pdf], ignore_index=True)
            if pdf is None or not len(pdf):
                continue
            names = pdf[[*keys, "frame"]].to_numpy()
            other = np.flatnonzero((names != names[-1]).any(axis=1))
            cut = len(pdf) if last else int(other[-1]) + 1 if len(other) else 0
            kept = pdf.iloc[cut:] if cut < len(pdf) else None
            edge = [0, *(np.flatnonzero((names[1:cut, :-1] != names[: max(0, cut - 1), :-1]).any(axis=1)) + 1).tolist(), cut]
            for a, z in zip(edge, edge[1:]):  # noqa: B905
                if z > a:
                    if now != tuple(names[a, :-1]):
                        now, state = tuple(names[a, :-1]), {}
                    yield step(state, pdf.iloc[a:z])

    return df.repartition(*([places] if places else []), *keys).sortWithinPartitions(*keys, "frame", "det_idx").mapInPandas(run, schema)


def tracked(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
    ids = [i for _, b in frames(pdf) for i in follow(state, b)]
    return pd.DataFrame({"video": pdf["video"], "frame": pdf["frame"], "det_idx": pdf["det_idx"], "track_id": np.array(ids, np.int64)})


def track_video(pdf: pd.DataFrame) -> pd.DataFrame:
    return tracked({}, pdf.sort_values(["frame", "det_idx"], kind="stable"))


def tags_of(spark, sf_dir) -> DataFrame:
    return adapter(spark, sf_dir, "detections").where("cls = 1").select("video", "frame", "det_idx", "x1", "y1", "x2", "y2")


@frame("greedy_ids")
def greedy_ids(spark, sf_dir):
    return folded(tags_of(spark, sf_dir), ["video"], tracked, "video long, frame long, det_idx long, track_id long")


def alive(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
    """After each frame: the ids that the tracker still holds, seen in it or not."""
    rows = []
    for at, b in frames(pdf):
        follow(state, b)
        rows.append((int(pdf["video"].iloc[0]), at, len(state["tags"]), ",".join(map(str, sorted(state["tags"])))))
    return pd.DataFrame(rows, columns=["video", "frame", "n", "ids"])


@frame("alive_ids")
def alive_ids(spark, sf_dir):
    """A window stays open as long as its id is alive."""
    return folded(tags_of(spark, sf_dir), ["video"], alive, "video long, frame long, n long, ids string")


def associations(tracks: Associations, pdf: pd.DataFrame):
    """What follow() finds in each frame of these rows."""
    at, boxes, conf = pdf["frame"].to_numpy(), pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["conf"].to_numpy(float)
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    for a, z in zip(cuts, cuts[1:]):  # noqa: B905
        yield tracks.follow(int(at[a]), boxes[a:z], conf[a:z])


def associated(state: dict, pdf: pd.DataFrame, max_age: int = MAX_AGE, least: float = LEAST_OVERLAP) -> pd.DataFrame:
    """Tracks of these rows of whole frames, and whether a track shows yet; the state holds the live tracks."""
    found = associations(state.setdefault("tracks", Association(max_age, least)), pdf)
    ids, shows = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"video": pdf["video"], "frame": pdf["frame"], "det_idx": pdf["det_idx"], "track_id": ids, "shown": shows})


def animals(spark, sf_dir, least_conf: float = 0.25) -> DataFrame:
    """Boxes that are surer than least_conf."""
    return adapter(spark, sf_dir, "detections").where((F.col("cls") == 0) & (F.col("conf") > least_conf)).select("video", "frame", "det_idx", "x1", "y1", "x2", "y2", "conf")


@frame("motion_tracks")
def motion_tracks(spark, sf_dir):
    """Observation-centred association (association.py) of each video, gaps between frames included."""
    return folded(animals(spark, sf_dir), ["video"], associated, "video long, frame long, det_idx long, track_id long, shown boolean")


def replayed(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each configuration of this part: ids that show for the first time in these frames, and births: those that did not show in the frame before."""
    part = int(pdf["part"].iloc[0])
    tracks = state.setdefault("tracks", Associations(*zip(*CONFIGS[part::PARTS], strict=True)))
    before = tracks.ids_shown.copy(), tracks.births.copy()
    for _ in associations(tracks, pdf):
        pass
    return pd.DataFrame({"config": range(part, len(CONFIGS), PARTS), "ids": tracks.ids_shown - before[0], "births": tracks.births - before[1]})


@frame("param_sweep")
def param_sweep(spark, sf_dir):
    """Ids that show, and births, of each configuration, replayed over the same input; best is the first of the fewest ids. A task follows a video under the configurations of a part at once."""
    rows = animals(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    sums = folded(rows, ["part", "video"], replayed, "config int, ids long, births long", PLACES).groupBy("config").agg(F.sum("ids").alias("ids"), F.sum("births").alias("births"))
    return sums.withColumn("best", F.row_number().over(Window.orderBy("ids", "config")) == 1)  # a row a configuration
