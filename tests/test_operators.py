from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tagstream import catalog
from tagstream.operators import dedup, windows
from tagstream.operators.dedup import crop_pairs, crops_by_band, hamming_pairs, lead, pairs_kept
from tagstream.operators.identity import follow, track_video
from tagstream.operators.spatial import suppress
from tagstream.plans.graph import components
from tagstream.sources import io
from tagstream.sources.adapters import ADAPTERS

SF = "/root/testdata/sf0.001"
ORACLED = ["digit_balance", "label_merge", "label_conflicts", "left_validity", "priority_queue", "crop_padded", "tag_to_animal", "smallest_container", "position_rank", "heading_held", "code_held", "identity_events", "hamming_pairs", "dup_components", "dup_representatives", "kfold", "topup_plan", "disagreements", "fps_ema", "hash_bits", "topup_mean", "disagreements_sure", "possible_swaps", "coco_rollup", "annotation_lists", "even_sample", "tombstones", "copied_paths", "dedup_summary", "frame_seek", "rate_sample", "limited_sample", "sequential_scan", "probe_record", "size_totals", "path_parts", "label_texts", "bootstrap_accept", "grid_position", "zip_join", "remote_listing", "augment_draws", "ocr_rows", "epoch_metrics", "label_report", "digit_order"]


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(tuple(str(round(r[k], 6) if isinstance(r[k], float) else r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", ORACLED)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    found = c.execute(catalog.SQL[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in found.description], found.fetchall())


def test_leader_rolls_and_expires():
    crops = pd.DataFrame({"video": 0, "crop_id": range(5), "frame": [0, 1, 2, 300, 300], "hash": [0, 7, 63, 63, 0]})
    assert lead(crops, 3, 150)["cluster"].tolist() == [0, 0, 0, 1, 2]


def test_pairs_of_64_bit_hashes(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(40, 64, 60).astype(np.uint64))
    h = np.concatenate([base, near, base ^ np.uint64(2**63)])
    rows = [(k, int(k % 2), int(rng.integers(0, 30)), int(x)) for k, x in enumerate(h.view(np.int64))]
    got = hamming_pairs(spark.createDataFrame(rows, "crop_id long, video long, frame long, hash long"), 6, 10, 64)
    apart = lambda a, b: int(np.bitwise_count(np.uint64(a & 2**64 - 1) ^ np.uint64(b & 2**64 - 1)))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 10 and apart(a[3], b[3]) <= 6}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) > 20


def test_undecodable_crops_share_hash_zero():
    crops = pd.DataFrame({"video": 0, "crop_id": [1, 2], "frame": [5, 5], "hash": [0, 0]})
    assert lead(crops)["cluster"].tolist() == [0, 0]


def test_follow_frees_ids_after_misses():
    state: dict = {}
    box = np.array([[0.0, 0, 10, 10]])
    assert follow(state, box) == [0]
    for _ in range(16):
        follow(state, np.empty((0, 4)))
    assert follow(state, box) == [1]
    assert follow(state, box + 500) == [2]


def test_suppress_keeps_first_of_equals():
    d = pd.DataFrame({"video": 0, "frame": 0, "det_idx": [0, 1, 2], "cls": 1, "x1": [0.0, 1, 50], "y1": [0.0, 0, 50], "x2": [10.0, 11, 60], "y2": [10.0, 10, 60], "conf": [0.5, 0.5, 0.4]})
    assert suppress(d)["det_idx"].tolist() == [0, 2]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_random_edges(spark, small):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 120, (80, 2))] + [(k, k + 1) for k in range(500, 540)] + [(900, k) for k in range(901, 940)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_csv_round_trip_keeps_backslashes(spark, tmp_path):
    df = spark.createDataFrame([("a\\b\\c.jpg", "3", 0.9), ("d.jpg", "", 0.1)], "crop_path string, digit string, score double")
    io.write_csv(df, str(tmp_path / "t"), df.columns)
    assert sorted(r.crop_path for r in io.read_csv(spark, str(tmp_path / "t"), "ocr_labels").collect()) == ["a\\b\\c.jpg", "d.jpg"]
    assert io.read_csv(spark, str(tmp_path / "none"), "ocr_labels", optional=True).count() == 0


def test_coco_and_voc(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", 64, 36), (2, "b.jpg", 64, 36)], "id long, file_name string, width int, height int")
    boxes = spark.createDataFrame([(1, 1, 7, [1.0, 2.0, 3.5, 4.5], 15.75, 0, 0.5)], "id long, image_id long, category_id int, bbox array<double>, area double, iscrowd int, score double")
    names = spark.createDataFrame([(7, "a&b")], "id int, name string")
    (tmp_path / "c.json").write_text(io.coco_document(images, boxes, names).first().value)
    got = io.read_coco(spark, str(tmp_path / "c.json")).orderBy("image_id").collect()
    assert [(r.image_id, r.name, r.x2) for r in got] == [(1, "a&b", 4.5), (2, None, None)]
    voc = spark.createDataFrame([("a.jpg", 64, 36, 0, "a&b", 0.5, 1.5, 2.5, 3.4)], "file_name string, width int, height int, det_idx int, name string, x1 double, y1 double, x2 double, y2 double")
    xml = io.voc_xml(voc).first().xml
    assert "<name>a&amp;b</name>" in xml and "<xmin>0</xmin><ymin>2</ymin><xmax>2</xmax><ymax>3</ymax>" in xml


def test_class_names_and_rewrite(spark, tmp_path):
    assert [r.name for r in io.class_names(spark, "names:\n  0: animal\n  1: tag\n").collect()] == ["animal", "tag"]
    assert [r.name for r in io.class_names(spark, "names: [animal, 'tag']").collect()] == ["animal", "tag"]
    p = str(tmp_path / "t")
    spark.range(5).write.parquet(p)
    io.rewrite(spark, p, lambda df: df.where("id < 2"))
    assert spark.read.parquet(p).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from tagstream.sources.schemas import SCHEMAS
    from tagstream.streaming.tracker import track_stream

    d = spark.sql(ADAPTERS["detections"].format(lineitem=f"parquet.`{SF}/lineitem.parquet`")).where("cls = 1 AND frame < 60")
    for k in range(3):
        d.where(f"frame >= {20 * k} AND frame < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = track_stream(spark.readStream.schema(SCHEMAS["detections"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = d.select("video", "frame", "det_idx", "x1", "y1", "x2", "y2").groupBy("video").applyInPandas(track_video, "video long, frame long, det_idx long, track_id long")
    assert sorted(map(tuple, spark.table("tracks").collect())) == sorted(map(tuple, batch.collect()))


def plain_tracker(rows):
    """The nearest-centre tracker in plain Python. rows: (frame, boxes); gives the ids of each frame's boxes, and the ids alive after it."""
    tags, fresh, out = {}, 0, []
    for _, boxes in rows:
        centres = [((a + c) / 2, (b + d) / 2) for a, b, c, d in boxes]
        pairs = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, t, j) for t, (u, v, _m) in tags.items() for j, (x, y) in enumerate(centres)]
        got, taken = {}, set()
        for dist, t, j in sorted((p for p in pairs if p[0] <= 400), key=lambda p: p[0]):
            if t not in taken and j not in got:
                got[j], tags[t] = t, (*centres[j], 0)
                taken.add(t)
        for t in list(tags):
            if t not in taken:
                x, y, m = tags[t]
                tags[t] = (x, y, m + 1)
                if m + 1 > 15:
                    del tags[t]
        for j, c in enumerate(centres):
            if j not in got:
                got[j], tags[fresh] = fresh, (*c, 0)
                fresh += 1
        out.append(([got[j] for j in range(len(centres))], sorted(tags)))
    return out


def test_greedy_ids_and_alive_against_plain_tracker(spark):
    d = spark.sql(ADAPTERS["detections"].format(lineitem=f"parquet.`{SF}/lineitem.parquet`")).where("cls = 1").toPandas().sort_values(["video", "frame", "det_idx"])
    ids = {(r.video, r.frame, r.det_idx): r.track_id for r in catalog.QUERIES["greedy_ids"](spark, SF).collect()}
    kept = {(r.video, r.frame): r.ids for r in catalog.QUERIES["alive_ids"](spark, SF).collect()}
    assert len(ids) == len(d)
    for video, part in d.groupby("video"):
        groups = list(part.groupby("frame"))
        for (at, rows), (own, alive) in zip(groups, plain_tracker([(f, g[["x1", "y1", "x2", "y2"]].to_numpy().tolist()) for f, g in groups]), strict=True):
            assert [ids[(video, at, k)] for k in rows["det_idx"]] == own
            assert kept[(video, at)] == ",".join(map(str, alive))


def test_assignment_gives_the_greatest_sum():
    from itertools import permutations

    from tagstream.operators.association import assign

    rng = np.random.default_rng(4)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2).tolist()
        gain = np.round(rng.normal(size=(n, m)), int(rng.integers(0, 4)))
        got = assign(gain)
        wide = gain if n <= m else gain.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(max(n, m)), min(n, m)))
        assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got}) and abs(sum(gain[i, j] for i, j in got) - best) < 1e-9


def test_few_and_many_tracks_are_filtered_alike(monkeypatch):
    """Re-updates number by number and by arrays agree to the last bit, and array steps aren't taken for a few tracks."""
    from tagstream.operators import association

    rng, found, steps = np.random.default_rng(5), [], [0]
    corner = rng.integers(0, 400, (300, 6, 2)).astype(float)
    boxes = np.concatenate([corner, corner + rng.integers(40, 160, (300, 6, 2))], axis=2)
    plain = association.predict
    monkeypatch.setattr(association, "predict", lambda m: steps.append(steps.pop() + 1) or plain(m))
    for few in (association.FEW, 0):
        monkeypatch.setattr(association, "FEW", few)
        tracks, steps[0] = association.Association(60, 0.2), 0
        shown = [tuple(map(tuple, tracks.follow(2 * k, b, np.full(6, 0.5)))) for k, b in enumerate(boxes)]
        found.append((shown, tracks.motion.tobytes(), tracks.kept.tobytes(), steps[0]))
    assert found[0][:3] == found[1][:3] and found[0][3] <= 2 * len(boxes) < found[1][3]


def plain_association(rows, max_age, least):
    """One track at a time, with whole matrices: (ids, shows) of each frame of (frame, boxes, scores), ids that show, births."""
    from tagstream.operators.association import assign

    f = np.eye(7)
    f[[0, 1, 2], [4, 5, 6]] = 1
    h, r = np.eye(4, 7), np.diag([1.0, 1, 10, 10])
    q = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001])
    z_of = lambda b: np.array([b[0] + (b[2] - b[0]) / 2, b[1] + (b[3] - b[1]) / 2, (b[2] - b[0]) * (b[3] - b[1]), (b[2] - b[0]) / (b[3] - b[1] + 1e-6)])

    def step(x, p):
        x = x.copy()
        if x[2] + x[6] <= 0:
            x[6] = 0
        return f @ x, f @ p @ f.T + q

    def update(x, p, z):
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        return x + k @ (z - h @ x), (np.eye(7) - k @ h) @ p

    def box_of(x):
        if x[2] * x[3] <= 0:
            return None
        w = (x[2] * x[3]) ** 0.5
        return x[0] - w / 2, x[1] - x[2] / w / 2, x[0] + w / 2, x[1] + x[2] / w / 2

    def iou(a, b):
        if a is None:
            return 0.0
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    def way(a, b):
        d = np.array([(b[0] + b[2] - a[0] - a[2]) / 2, (b[1] + b[3] - a[1] - a[3]) / 2])
        return d / (np.hypot(*d) + 1e-6)

    tracks, n, out, shown, births, before = [], 0, [], set(), 0, set()
    given = {at: (boxes, scores) for at, boxes, scores in rows}
    for at in range(max(given) + 1):
        boxes, scores = given.get(at, ([], []))
        for t in tracks:
            if t["missed"]:
                t["streak"] = 0
            t["missed"] += 1
            t["x"], t["p"] = step(t["x"], t["p"])
        ref = [next((t["seen"][at - k] for k in (3, 2, 1) if at - k in t["seen"]), t["last"]) for t in tracks]
        got = {}
        if tracks and boxes:
            over = np.array([[iou(box_of(t["x"]), b) for b in boxes] for t in tracks])
            gain = over.copy()
            for i, t in enumerate(tracks):
                for j, b in enumerate(boxes):
                    if t["last"] is not None:
                        turn = np.arccos(np.clip(way(ref[i], b) @ t["way"], -1, 1))
                        gain[i, j] += 0.2 * (np.pi / 2 - turn) / np.pi * scores[j]
            near = over > least
            if near.any() and near.sum(0).max() == 1 and near.sum(1).max() == 1:
                found = [(i, j) for i in range(len(tracks)) for j in range(len(boxes)) if near[i, j]]
            else:
                found = [(i, j) for i, j in assign(gain) if over[i, j] >= least] if over.max() >= least else []
            got = {j: i for i, j in found}
            free = [i for i, t in enumerate(tracks) if i not in got.values() and t["last"] is not None]
            left = [j for j in range(len(boxes)) if j not in got]
            if free and left:
                over = np.array([[iou(tracks[i]["last"], boxes[j]) for j in left] for i in free])
                if over.max() >= least:
                    got |= {left[j]: free[i] for i, j in assign(over) if over[i, j] >= least}
        ids = []
        for j, b in enumerate(boxes):
            if j not in got:
                n += 1
                tracks.append({"id": n, "x": np.concatenate([z_of(b), np.zeros(3)]), "p": np.diag([10.0] * 4 + [10000.0] * 3), "missed": 0, "streak": 0, "seen": {}, "last": None, "way": np.zeros(2)})
                ids.append(tracks[-1])
                continue
            t = tracks[got[j]]
            if t["last"] is not None and t["missed"] > 1:
                gap, a = t["missed"], np.array(t["last"])
                x, p = t["kept"]
                mid = lambda v: np.array([(v[0] + v[2]) / 2, (v[1] + v[3]) / 2, v[2] - v[0], v[3] - v[1]])
                for k in range(1, gap + 1):
                    x, p = step(x, p)
                    if k < gap:
                        c = mid(a) + (mid(np.array(b)) - mid(a)) * k / gap
                        x, p = update(x, p, np.array([c[0], c[1], c[2] * c[3], c[2] / (c[3] + 1e-6)]))
                t["x"], t["p"] = x, p
            t["x"], t["p"] = update(t["x"], t["p"], z_of(b))
            if t["last"] is not None:
                t["way"] = way(ref[got[j]], b)
            t["kept"], t["last"], t["missed"], t["streak"] = (t["x"], t["p"]), b, 0, t["streak"] + 1
            t["seen"][at] = b
            ids.append(t)
        shows = [t["streak"] >= 3 or at < 3 for t in ids]
        now = {t["id"] for t, s in zip(ids, shows, strict=True) if s}
        shown, births, before = shown | now, births + len(now - before), now
        tracks = [t for t in tracks if t["missed"] <= max_age]
        if at in given:
            out.append(([t["id"] for t in ids], shows))
    return out, len(shown), births


def test_settings_followed_at_once_are_as_each_alone(monkeypatch):
    """A sweep's settings share the steps over a frame; frames without boxes, tracks that wait for their first match, and ends included."""
    from tagstream.operators import association
    from tagstream.operators.identity import CONFIGS

    rng, rows, at, steps = np.random.default_rng(6), [], 0, [0]
    for k in range(120):
        at += 45 if k == 60 else int(rng.integers(1, 5))
        n = int(rng.integers(1, 7))
        corner = rng.integers(0, 300, (n, 2)).astype(float)
        rows.append((at, np.concatenate([corner, corner + rng.integers(60, 180, (n, 2))], axis=1), rng.uniform(0.3, 0.9, n)))
    plain = association.predict
    monkeypatch.setattr(association, "predict", lambda m: steps.append(steps.pop() + 1) or plain(m))
    tracks = association.Associations(*zip(*CONFIGS, strict=True))
    got = [tracks.follow(*x) for x in rows]
    assert steps[0] <= at + 1
    for k, setting in enumerate(CONFIGS):
        found, shown, births = plain_association([(f, b.tolist(), c.tolist()) for f, b, c in rows], *setting)
        assert [(ids[k].tolist(), shows[k].tolist()) for ids, shows in got] == [(ids, [bool(x) for x in shows]) for ids, shows in found]
        assert (tracks.ids_shown[k], tracks.births[k]) == (shown, births)


def test_motion_tracks_and_sweep_against_plain_tracker(spark):
    from tagstream.operators.identity import CONFIGS

    d = spark.sql(ADAPTERS["detections"].format(lineitem=f"parquet.`{SF}/lineitem.parquet`")).where("cls = 0 AND conf > 0.25").toPandas().sort_values(["video", "frame", "det_idx"])
    got = {(r.video, r.frame, r.det_idx): (r.track_id, r.shown) for r in catalog.QUERIES["motion_tracks"](spark, SF).collect()}
    assert len(got) == len(d)
    sums = {k: [0, 0] for k in range(len(CONFIGS))}
    for video, part in d.groupby("video"):
        groups = [(f, g[["x1", "y1", "x2", "y2"]].to_numpy().tolist(), g["conf"].tolist(), g["det_idx"].tolist()) for f, g in part.groupby("frame")]
        for (at, _, _, names), (own, shows) in zip(groups, plain_association([g[:3] for g in groups], 150, 0.2)[0], strict=True):
            assert [got[(video, at, k)] for k in names] == list(zip(own, shows, strict=True))
        for k in (0, 6):
            for i, x in enumerate(plain_association([g[:3] for g in groups], *CONFIGS[k])[1:]):
                sums[k][i] += x
    swept = {r.config: (r.ids, r.births, r.best) for r in catalog.QUERIES["param_sweep"](spark, SF).collect()}
    assert all(list(swept[k][:2]) == sums[k] for k in (0, 6))
    assert [k for k, v in swept.items() if v[2]] == [min(swept, key=lambda k: (swept[k][0], k))]



def test_folds_stream_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        small = {name: sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) for name in ("greedy_ids", "leader_clusters")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == {name: sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) for name in small}


def test_leader_clusters_and_nms_against_plain_loops(spark):
    crops = spark.sql(ADAPTERS["crops"].format(lineitem=f"parquet.`{SF}/lineitem.parquet`")).toPandas().sort_values(["video", "frame", "crop_id"])
    got = {r.crop_id: (r.video, r.cluster) for r in catalog.QUERIES["leader_clusters"](spark, SF).collect()}
    for video, part in crops.groupby("video"):
        leaders, n = [], 0
        for c, f, h in zip(part["crop_id"], part["frame"], part["hash"], strict=True):
            leaders = [x for x in leaders if f - x[1] <= 30]
            near = min(leaders, key=lambda x: bin(x[0] ^ h).count("1"), default=None)
            if near is None or bin(near[0] ^ h).count("1") > 2:
                near = [h, f, n]
                leaders.append(near)
                n += 1
            near[0], near[1] = h, f
            assert got[c] == (video, near[2])
    d = spark.sql(ADAPTERS["detections"].format(lineitem=f"parquet.`{SF}/lineitem.parquet`")).where("frame < 60").toPandas()
    kept = {(r.video, r.frame, r.det_idx) for r in catalog.QUERIES["nms"](spark, SF).where("frame < 60").collect()}
    brute = set()
    for (video, at, _), g in d.groupby(["video", "frame", "cls"]):
        chosen = []
        for r in sorted(g.itertuples(), key=lambda r: (-r.conf, r.det_idx)):
            fits = True
            for o in chosen:
                both = max(0, min(r.x2, o.x2) - max(r.x1, o.x1)) * max(0, min(r.y2, o.y2) - max(r.y1, o.y1))
                fits &= both <= 0.4 * ((r.x2 - r.x1) * (r.y2 - r.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - both)
            if fits:
                chosen.append(r)
        brute |= {(video, at, r.det_idx) for r in chosen}
    assert kept == brute


def test_reconciler_equals_the_window_queries_and_its_stream(spark, tmp_path):
    from tagstream.streaming.reconciler import reconcile, reconcile_stream

    reads = spark.sql(ADAPTERS["tag_reads"].format(events=f"parquet.`{SF}/events.parquet`")).select("frame", "track_id", "code").orderBy("frame")
    events = reconcile({}, [(r.frame, r.track_id, r.code) for r in reads.collect()])
    named = {(f, t, old, code) for kind, f, code, t, old, _ in events if kind == "identity_reassigned"}
    assert named == {(r.frame, r.track_id, r.old_code, r.new_code) for r in catalog.QUERIES["identity_events"](spark, SF).collect()}
    swaps = {(f, code, t, o) for kind, f, code, t, _, all_ in events if kind == "possible_swap" for o in all_[1:]}
    assert swaps == {(r.frame, r.code, r.track_id, r.other) for r in catalog.QUERIES["possible_swaps"](spark, SF).collect()} and swaps
    n = reads.count()
    for k in range(3):
        reads.where(f"frame >= {n * k // 3} AND frame < {n * (k + 1) // 3}").selectExpr("0L AS video", "*").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from tagstream.streaming.progress import Progress

    seen = Progress(every=100)
    spark.streams.addListener(seen)
    source = spark.readStream.schema("video long, frame long, track_id long, code string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reconcile_stream(source).writeStream.format("memory").queryName("events_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.type, r.frame, r.code, r.track_id, r.old_code, r.tracks) for r in spark.table("events_out").collect())
    assert [x[:4] for x in got] == sorted(x[:4] for x in events)
    import time

    for _ in range(50):
        if seen.rows >= n:
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert seen.rows == n and seen.lines


def test_texts_of_durations_codes_and_paths(spark):
    from pyspark.sql import functions as F

    from tagstream.operators import media

    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert [one(media.duration_text(F.lit(s))) for s in (0.0, 59.999, 3661.5, 36000.25)] == ["0:00:00.00", "0:00:60.00", "1:01:01.50", "10:00:00.25"]
    assert one(media.fourcc(F.lit(int.from_bytes(b"hvc1", "little")))) == "hvc1"
    assert one(media.relative_to(F.lit("C:\\work\\project\\a\\b.JPG"), media.ROOT)) == "a\\b.JPG"
    assert [one(media.suffix(F.lit(x))) for x in ("a.JPG", ".hidden", "none", "a.b.PnG")] == [".jpg", "", "", ".png"]
    pages = spark.createDataFrame([(1, [("a", 1), ("b", 2), ("a", 3)]), (2, [("b", 9)]), (3, [])], "page long, items array<struct<name:string,id:long>>")
    assert {r.name: r.id for r in media.flattened(pages).collect()} == {"a": 3, "b": 9}


def test_table_function_gives_none_to_many_rows(spark):
    from tagstream.functions.udtf import RecognizedTexts

    spark.udtf.register("recognized_texts", RecognizedTexts)
    rows = spark.sql("""SELECT n, t.* FROM VALUES (1, '{"rec_texts": ["a", "b"], "rec_scores": [0.5, 1]}'), (2, NULL), (3, '{}') v(n, r), LATERAL recognized_texts(r) t""").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "a", 0.5), (1, 1, "b", 1.0)]


def test_tables_are_replaced_whole_or_not_at_all(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(5).write.parquet(p)
    fs, path_of = io.file_system(spark, p)
    spark.range(3).write.parquet(p + ".new")
    fs.rename(path_of(p), path_of(p + ".old"))  # cut off between the two renames
    io.recover(spark, p)
    assert spark.read.parquet(p).count() == 3 and not fs.exists(path_of(p + ".old"))
    fs.rename(path_of(p), path_of(p + ".old"))  # nothing new was written
    io.recover(spark, p)
    assert spark.read.parquet(p).count() == 3
    io.rewrite(spark, p, lambda df: df.where("id < 1"))
    assert spark.read.parquet(p).count() == 1
    io.append_log(spark.range(2), p)
    assert spark.read.parquet(p).count() == 3
    io.write_by(spark.range(10).selectExpr("id", "id % 2 AS digit"), str(tmp_path / "by"), "digit")
    assert spark.read.parquet(str(tmp_path / "by")).where("digit = 1").count() == 5


def test_checks_and_existing_predictions(spark, tmp_path):
    p = str(tmp_path / "preds")
    spark.createDataFrame([("5", 0.9), ("0", 0.9), ("12", 0.9), ("7", 0.5), ("7", 0.75)], "pred_text string, score double").write.parquet(p)
    assert sorted((r.pred_text, r.score) for r in io.from_existing(spark, p, 0.75).collect()) == [("5", 0.9), ("7", 0.75)]
    assert io.scene_check(spark, p, shown=False, saved="x") == []
    assert len(io.scene_check(spark, p + "x", (p, p + "y"), shown=False)) == 3
    (tmp_path / "a.csv").write_text("crop_path,digit\nx,1\ny,2\n")
    (tmp_path / "b.csv").write_text("crop_path,digit\nx,3\n")
    keys = io.labelled_keys(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "none.csv"))
    assert sorted(r.crop_path for r in keys.collect()) == ["x", "y"]


def test_images_are_listed_decoded_and_hashed(spark, tmp_path):
    from tagstream.functions.images import dhash_of, hashed, shrunk

    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(27, 16, 1)
    for x in range(27):
        for y in range(16):
            image.setRGB(x, y, (9 * x) * 65793 if y < 8 else (250 - 9 * x) * 65793)
    jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(str(tmp_path / "b.png")))
    (tmp_path / "a.png").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in io.list_files(spark, str(tmp_path), "*.png").collect()] == ["a.png", "b.png"]
    rows = hashed(io.read_images(spark, str(tmp_path), "*.png")).collect()
    assert [r.hash for r in rows] == [(1 << 32) - 1]  # four rows that get lighter, four that get darker
    assert dhash_of(b"", 0, 0, 3) == dhash_of(b"abc", 5, 5, 3) == 0
    assert shrunk(np.arange(12.0).reshape(3, 4), 1, 2).tolist() == [[4.5, 6.5]]


def test_numbered_equals_row_number(spark):
    from pyspark.sql import functions as F

    from tagstream.plans.shared import numbered

    df = spark.range(1000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    got = [(r.h, r.n) for r in numbered(df, "n", F.desc("h")).orderBy("n").collect()]
    assert got == [(h, k + 1) for k, h in enumerate(sorted((r.h for r in df.collect()), reverse=True))]


def test_top_up_goes_on_after_gaps(spark):
    from tagstream.operators.labels import turns

    real = spark.createDataFrame([(1, "5"), (2, "5"), (3, "7"), *((k, "1") for k in range(10, 30))], "crop_id long, digit string")
    before = spark.createDataFrame([("5", 1, 4), ("5", 1, 0), ("7", 3, None)], "digit string, source_crop_id long, index long")
    got = sorted(map(tuple, turns(real, before, ["5", "7"], 8).select("digit", "source_crop_id", "aug_index").collect()))
    assert got == [("5", 1, 5), ("5", 1, 6), ("5", 2, 0), ("5", 2, 1), *(("7", 3, k) for k in range(6))]
    assert sorted((r.digit, r.source_crop_id) for r in turns(real, before, ["7"], None).collect()) == [("7", 3)]  # the mean of 23 rows over 9 classes is 3


def sql_and_query(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables (column -> values)."""
    c = duckdb.connect()
    for t, cols in tables.items():
        given = pd.DataFrame(cols)  # noqa: F841
        c.execute(f"COPY (SELECT * FROM given) TO '{folder}/{t}.parquet'")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    found = c.execute(catalog.SQL[name])
    return rows(df.columns, df.collect()), rows([x[0] for x in found.description], found.fetchall())


def test_rate_of_rows_that_took_no_time(spark, tmp_path):
    at = pd.Timestamp("2024-01-01").as_unit("us") + pd.to_timedelta(range(6), unit="s").as_unit("us")
    got, want = sql_and_query(spark, tmp_path, "fps_ma", events={"event_id": range(6), "ts": at, "user_id": [1, 1, 1, 2, 2, 2], "event_type": "view", "value": [0.0, 0.0, 20.0, 5.0, 0.0, 1.0], "props": ""})
    assert got == want and sum("inf" in r for r in got) == 2


def test_rate_is_rounded_as_in_sql(spark, tmp_path):
    """Rates that end in a five at the fifth decimal, and very high ones: decimal rounding gives 22.1021 for the first."""
    value = [45.244671874328404, 1.1663109904108826, 1.846854230104186, 2.4799216245569777, 1e-11, 3e-12, 7e-300, 1e-304, 51.2, 30.0]
    n = len(value)
    at = pd.Timestamp("2024-01-01").as_unit("us") + pd.to_timedelta(range(n), unit="s").as_unit("us")
    events = {"event_id": range(n), "ts": at, "user_id": range(n), "event_type": "view", "value": value, "props": ""}
    got, want = sql_and_query(spark, tmp_path, "fps_ma", events=events)
    assert got == want


def test_beads_on_the_axis(spark, tmp_path):
    parts = [310151, 312343, 315260, 337145, 338727, 337211, 332853, 334937, 323331]
    beads = {"l_orderkey": [2294438] * 3 + [2491480] * 6, "l_linenumber": [1, 2, 3, 1, 2, 3, 4, 5, 6], "l_partkey": parts, "l_suppkey": [15735, 15694, 15068, 16377, 16834, 16092, 16751, 16931, 16764]}
    got, want = sql_and_query(spark, tmp_path, "position_rank", lineitem=beads | {"l_quantity": 1.0, "l_extendedprice": 1.0, "l_discount": 0.0, "l_shipdate": pd.Timestamp("2024-01-01").as_unit("us")})
    assert got == want


def test_crops_are_numbered_band_by_band(spark):
    """The ids of one order over all rows, rows at the end of a band under the same id in the next; no task gets all rows."""
    folder = SF.replace("sf0.001", "sf0.01")
    crops, width = crops_by_band(spark, folder, band_rows=1000)
    want = {tuple(r) for r in spark.sql(ADAPTERS["crops"].format(lineitem=f"parquet.`{folder}/lineitem.parquet`")).select("crop_id", "video", "frame", "hash").collect()}
    got = [tuple(r) for r in crops.select("crop_id", "video", "frame", "hash", "band").collect()]
    assert {r[:4] for r in got} == want and len({r[4] for r in got}) > 3
    assert len([r for r in got if r[2] // width == r[4]]) == len(want) < len(got)
    assert "SinglePartition" not in crop_pairs(spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_pairs_in_rounds(spark, monkeypatch):
    """Rounds of bands find the pairs of one round, and each crop moves in one round but for the ends of bands."""
    folder = SF.replace("sf0.001", "sf0.01")
    rounds = []
    monkeypatch.setattr(dedup, "kept", lambda df, name, *more, f=dedup.kept: rounds.append(1 + len(more)) or f(df, name, *more))
    got = pairs_kept(spark, folder, band_rows=1000, round_rows=10_000)
    names = lambda df: sorted(tuple(r) for r in df.select("x.crop_id", "x.frame", "y.crop_id", "y.frame").collect())
    assert names(got) == names(crop_pairs(spark, folder)) and 3 < rounds[0] <= dedup.ROUNDS


def test_representatives_by_blocks_of_numbers(spark, monkeypatch):
    """Crops of no group are their own representatives, whatever the blocks; the crops themselves don't move for it."""
    want = sorted(tuple(r) for r in catalog.QUERIES["dup_representatives"](spark, SF).collect())
    monkeypatch.setattr(dedup, "BLOCK", 7)
    assert sorted(tuple(r) for r in catalog.QUERIES["dup_representatives"](spark, SF).collect()) == want
    monkeypatch.setattr(dedup, "crops_numbered", None)
    members = {r.crop_id: r for r in dedup.ranked_members(spark, SF).collect()}
    crops = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert want == sorted((k, members[k].component, members[k].size) if k in members else (k, k, 1) for k in range(crops) if k not in members or members[k].rn == 1)


def test_kept_tables_leave_no_shuffle_files(spark):
    import time

    from tagstream.plans.shared import CLEANUP, kept

    before = spark.conf.get(CLEANUP)
    files = lambda: {f for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    had = files()
    got = kept(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "few", spark.createDataFrame([(9, 1)], "k long, count long"))
    until = time.time() + 20
    while files() - had and time.time() < until:
        time.sleep(0.1)
    assert not files() - had and got.count() == 8 and spark.conf.get(CLEANUP) == before


def test_pairs_across_bands(spark):
    rows = [(k, 0, f, h) for k, (f, h) in enumerate([(252, 1), (253, 1), (255, 3), (256, 1), (256, 0), (258, 1), (512, 1), (515, 0), (516, 1)])]
    got = [tuple(r) for r in hamming_pairs(spark.createDataFrame(rows, "crop_id long, video long, frame long, hash long")).collect()]
    assert sorted(got) == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[2] - b[2]) <= 3]


def test_spans_are_cut_into_few_cells(spark):
    """Each frame of a span lies in one cell; a long span has few, however many bands it has."""
    rng = np.random.default_rng(3)
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 1 << 20, 200), 2 ** rng.integers(0, 21, 200), strict=True)] + [(0, 4096), (4096, 8192), (5000, 5001), (4095, 8193), (0, 1 << 24)]
    got = spark.createDataFrame(spans, "start long, until long").select("start", "until", windows.cells("start", "until").alias("cells")).collect()
    for start, until, cells in got:
        parts = sorted((max(start, c * w), min(until, (c + 1) * w)) for k, c in cells for w in [windows.SPAN << max(0, k)])
        assert parts[0][0] == start and parts[-1][1] == until and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))  # noqa: B905
        assert len(cells) <= 2 + 2 * windows.LEVELS + (until - start) // (windows.SPAN << windows.LEVELS)


def test_cells_grow_with_the_logarithm_of_the_frames(spark):
    for end in (1 << 20, 36_000_000, 1 << 36):
        top = windows.levels(end)
        (found,) = spark.sql(f"SELECT 1L AS start, {end}L AS until").select(windows.cells("start", "until", top)).first()
        assert len(found) <= 2 + 2 * top + 2 * windows.WIDE


@pytest.mark.parametrize("span", [1, 64])
def test_swaps_on_many_levels_equal_their_sql(spark, tmp_path, monkeypatch, span):
    """Few tracks and codes, with runs of unread rows, long ones too; more levels than a small table has."""
    monkeypatch.setattr(windows, "SPAN", span)
    monkeypatch.setattr(windows, "LEVELS", 0)
    monkeypatch.setattr(windows, "WIDE", 2)
    rng = np.random.default_rng(5)
    n = 3000
    at = pd.Timestamp("2024-01-01").as_unit("us") + pd.to_timedelta(rng.integers(0, 2000, n), unit="s").as_unit("us")
    kind = np.where(rng.random(n) < 0.3, "error", np.where(rng.random(n) < 0.7, "view", "click"))
    kind[np.argsort(at.to_numpy(), kind="stable")[1200:1900]] = "error"
    events = {"event_id": rng.permutation(n), "ts": at, "user_id": rng.integers(0, 9, n), "event_type": kind, "value": 1.0, "props": ""}
    got, want = sql_and_query(spark, tmp_path, "possible_swaps", events=events)
    assert got == want and len(got) > 100


def test_swaps_checkpoint_no_rows(spark):
    held = lambda: {str(f) for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("rdd-*")}
    before = held()
    assert catalog.QUERIES["possible_swaps"](spark, SF).count() and held() == before
