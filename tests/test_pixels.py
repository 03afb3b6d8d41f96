"""Pixels of augmented copies, the network's forward pass, and training in Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagstream import catalog
from tagstream.functions import network, pixels
from tagstream.operators import classifier

SF = "/root/testdata/sf0.001"
IMAGE = "crop_id long, height int, width int, nChannels int, data binary"


def image(seed, h, w, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)


def plain_turned(img, degrees, scale):
    h, w, _ = img.shape
    a, out = np.deg2rad(degrees), np.zeros_like(img)
    for y in range(h):
        for x in range(w):
            u, v = (x - w / 2) / scale, (y - h / 2) / scale
            sx = min(max(np.cos(a) * u - np.sin(a) * v + w / 2, 0), w - 1)
            sy = min(max(np.sin(a) * u + np.cos(a) * v + h / 2, 0), h - 1)
            total = np.zeros(3)
            for i in (int(sy), int(sy) + 1):
                for j in (int(sx), int(sx) + 1):
                    total += max(0, 1 - abs(sy - i)) * max(0, 1 - abs(sx - j)) * img[min(i, h - 1), min(j, w - 1)]
            out[y, x] = np.clip(np.round(total), 0, 255)
    return out


def plain_blurred(img, size):
    k = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}[size]
    img = img.astype(float)
    h, w, _ = img.shape
    mirror = lambda i, n: abs(i) if i < n else 2 * (n - 1) - i
    out = np.zeros(img.shape)
    for y in range(h):
        for x in range(w):
            for i, a in enumerate(k):
                for j, b in enumerate(k):
                    out[y, x] += a * b * img[mirror(y + i - size // 2, h), mirror(x + j - size // 2, w)] / sum(k) ** 2
    return np.floor(out + 0.5).astype(np.uint8)


def test_pixels_equal_plain_loops():
    img = image(1, 13, 17)
    for degrees, scale in ((0, 1), (10.5, 0.93), (-15, 1.08), (90, 1)):
        assert np.abs(pixels.turned(img, degrees, scale).astype(int) - plain_turned(img, degrees, scale)).max() <= (0 if degrees != 90 else 1)
    for size in (3, 5):
        assert (pixels.blurred(img, size) == plain_blurred(img, size)).all()
    assert (pixels.blurred(img, 0) == img).all() and (pixels.turned(img, 0, 1) == img).all()
    assert pixels.toned(img, 1.2, 0.9)[0, 0, 0] == int(min(255, np.float32(img[0, 0, 0]) * np.float32(0.9) + np.float32(12)))
    for n, size in ((13, 64), (64, 9), (1, 8), (7, 7)):
        m = pixels.cubic(n, size)
        assert np.allclose(m.sum(1), 1) and m.shape == (size, n)
    ramp = np.repeat(np.arange(0, 240, 4, dtype=np.uint8)[None, :, None], 60, 0).repeat(3, 2)
    assert np.abs(np.diff(pixels.resized(ramp, 30, 30)[5, 2:-2, 0].astype(int)) - 8).max() <= 1  # inside, a ramp stays one
    for x in (image(2, 1, 1), image(2, 1, 5), image(2, 5, 1)):
        assert pixels.augmented(x, 9, 1.05, 1.1, 0.9, 5).shape == x.shape


def test_copies_follow_the_draws(spark):
    draws = catalog.QUERIES["augment_draws"](spark, SF).withColumn("source_crop_id", F.col("crop_id") % 5)
    rows = [(k, 12 + k, 10, c, image(k, 12 + k, 10, c).tobytes()) for k, c in enumerate((3, 1, 4))] + [(3, 5, 5, 3, b"short"), (9, None, None, None, None)]
    images = spark.createDataFrame(rows, IMAGE.replace("crop_id", "source_crop_id"))
    got = {r.crop_id: r for r in pixels.augment(images, draws).collect()}
    wanted = {r.crop_id: r for r in draws.where("source_crop_id < 3").collect()}
    assert set(got) == set(wanted) and len(got) > 10
    for k, r in wanted.items():
        s = rows[r.source_crop_id]
        img = pixels.decoded(s[4], s[1], s[2], s[3])
        assert got[k].data == pixels.augmented(img, r.rotation, r.scale, r.brightness, r.contrast, r.blur).tobytes()


def plain_forward(w, x):
    """One image, one pixel at a time."""
    for b in range(network.blocks(w)):
        for k in range(2):
            h, v, c = x.shape
            out = np.zeros((h, v, w[f"conv{b}{k}"].shape[1]))
            for i in range(h):
                for j in range(v):
                    z = 0
                    for t in range(9):
                        y, u = i + t // 3 - 1, j + t % 3 - 1
                        if 0 <= y < h and 0 <= u < v:
                            z = z + x[y, u] @ w[f"conv{b}{k}"][t * c : t * c + c]
                    z = (z - w[f"mean{b}{k}"]) / np.sqrt(w[f"var{b}{k}"] + 1e-5) * w[f"gain{b}{k}"] + w[f"shift{b}{k}"]
                    out[i, j] = np.maximum(z, 0)
            x = out
        x = np.array([[x[i : i + 2, j : j + 2].max((0, 1)) for j in range(0, x.shape[1], 2)] for i in range(0, x.shape[0], 2)])
    feat = x.mean((0, 1))
    turn = feat @ w["turn"] + w["turn_shift"]
    return feat @ w["digit"] + w["digit_shift"], turn / np.hypot(*turn)


def rough(seed, channels, classes=9):
    rng = np.random.default_rng(seed)
    return {n: (np.abs(v + rng.normal(size=v.shape) / 5) if n.startswith("var") else v + rng.normal(size=v.shape) / 5).astype(np.float32) if n[:4] != "conv" else v for n, v in network.initial(seed, channels, classes).items()}


def test_scores_equal_a_plain_loop(spark, tmp_path):
    w = rough(3, (4, 6))
    classifier.save_weights(spark, w, str(tmp_path / "w"))
    back = classifier.load_weights(spark, str(tmp_path / "w"))
    assert set(back) == set(w) and all((back[n] == w[n]).all() for n in w)
    rows = [(k, 9 + k, 14, 3, image(k, 9 + k, 14).tobytes()) for k in range(20)] + [(90, 5, 5, 3, b"short"), (91, None, None, None, None)]
    got = {r.crop_id: r for r in classifier.score(spark.createDataFrame(rows, IMAGE).repartition(3), back, size=8).collect()}
    assert len(got) == 22 and got[90].digit is None and got[91].angle is None
    for k, h, v, c, data in rows[:20]:
        x = pixels.resized(pixels.decoded(data, h, v, c), 8, 8)[..., ::-1] / 255
        logits, turn = plain_forward(w, x)
        p = np.exp(logits - logits.max())
        assert got[k].digit == logits.argmax() and abs(got[k].confidence - p.max() / p.sum()) < 1e-4
        assert abs((got[k].angle - np.degrees(np.arctan2(*turn)) + 180) % 360 - 180) < 0.05
    assert network.initial(0)["conv21"].shape == (9 * 128, 128) and sum(v.size for v in network.initial(0).values()) * 4 < 1_300_000


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {n: v.astype(float) + (rng.normal(size=v.shape) * 0.3 if n[:4] != "conv" else 0) for n, v in network.initial(1, (3, 4), 5).items()}
    angle = rng.random(6) * 6
    b = network.Batch(image(5, 48, 8).reshape(6, 8, 8, 3), rng.integers(0, 5, 6), np.stack([np.sin(angle), np.cos(angle)], 1), np.array([1.0, 0, 1, 1, 0, 1]))
    weight = np.array([1, 2, 0.5, 1, 1])
    g, digit, turn = network.step(w, b, weight)

    def loss():
        _, d, t = network.step(w, b, weight)
        return d + t

    assert abs(loss() - digit - turn) < 1e-9
    for n in network.learnt(w):
        for _ in range(3):
            at = tuple(int(rng.integers(0, s)) for s in w[n].shape)
            x = w[n][at]
            w[n][at] = x + 1e-5
            up = loss()
            w[n][at] = x - 1e-5
            down = loss()
            w[n][at] = x
            assert abs((up - down) / 2e-5 - g[n][at]) < 2e-3 * (1 + abs(g[n][at])), n


def crops(n, size=8):
    """Crops of two digits by brightness of a half, with an angle by colour; the last fold's crops of digit 2 are unlike all others."""
    rows = []
    for k in range(n):
        digit, half = k % 2, k // 2 % 2
        x = image(k, size, size) // 4
        x[: size // 2] = x[: size // 2] + np.uint8(150 if digit else 0)
        x[..., 2] = x[..., 2] + np.uint8(40 * half)
        rows.append((k, x.tobytes(), digit, 90.0 * half, k % 5 > 0, k % 3))
    return rows


FIELDS = "crop_id long, x binary, digit int, angle double, valid boolean, fold int"


def test_training_lowers_the_loss_and_reruns_agree(spark, tmp_path):
    df = spark.createDataFrame(crops(120), FIELDS).repartition(4)
    batches = classifier.write_batches(df, str(tmp_path / "b"), per_batch=16)
    assert batches.selectExpr("sum(size(rows))").first()[0] == 120
    before = spark.conf.get(classifier.RECORDS)
    runs = [classifier.train(batches, [0, 1, 2], epochs=6, steps=2, rate=0.01, channels=(4, 6), classes=2) for _ in range(2)]
    assert spark.conf.get(classifier.RECORDS) == before
    (models, log), (again, log_again) = runs
    assert log == log_again and all((a[n] == b[n]).all() for a, b in zip(models, again, strict=True) for n in a)
    first, last = ([d + t for e, _, d, t in log if e == at] for at in (0, 5))
    assert all(b < 0.7 * a for a, b in zip(first, last, strict=True))
    found = {r.crop_id: r.digit for r in classifier.out_of_fold(df, models).collect()}
    assert len(found) == 120 and np.mean([found[k] == k % 2 for k in range(120)]) > 0.9


def test_a_fold_is_never_seen_by_its_model(spark, tmp_path):
    """Turning the labels of a fold around changes the models of the other folds, not its own."""
    rows = crops(60)
    turned = [(*r[:2], 1 - r[2] if r[5] == 1 else r[2], *r[3:]) for r in rows]
    models = []
    for k, part in enumerate((rows, turned)):
        batches = classifier.write_batches(spark.createDataFrame(part, FIELDS).coalesce(1), str(tmp_path / f"b{k}"), per_batch=20)
        models.append(classifier.train(batches, [0, 1, None], epochs=2, channels=(3,), classes=2)[0])
    same = [all((a[n] == b[n]).all() for n in a) for a, b in zip(*models, strict=True)]
    assert same == [False, True, False]


def test_class_weights(spark, tmp_path):
    rows = [(k, bytes(192), 0 if k < 6 else 2, 0.0, True, k % 2) for k in range(8)] + [(9, None, 1, 0.0, True, 0)]
    batches = classifier.write_batches(spark.createDataFrame(rows, FIELDS), str(tmp_path / "b"))
    got = classifier.class_weights(batches, [None, 0], 3)
    assert got[0] == pytest.approx([9 / 18, 9 / 3, 9 / 6]) and got[1] == pytest.approx([5 / 9, 5 / 3, 5 / 3])


def test_crops_are_the_pixels_of_the_padded_boxes(spark):
    from tagstream.operators import crops as c
    from tagstream.plans.dialect import adapter

    boxes = adapter(spark, SF, "detections").where("video = 1 AND frame < 30")
    wanted = {(r.video, r.frame, r.det_idx): (r.px1, r.py1, r.px2, r.py2) for r in catalog.QUERIES["crop_padded"](spark, SF).where("video = 1 AND frame < 30").collect()}
    frames = sorted({k[1] for k in wanted})
    pictures = {f: image(f, 360, 640) for f in frames[:-1]}
    rows = [(1, f, 360, 640, 3, p.tobytes()) for f, p in pictures.items()] + [(1, frames[-1], 360, 640, 3, b"short")]
    images = spark.createDataFrame(rows, "video long, frame long, height int, width int, nChannels int, data binary").repartition(3)
    odd = spark.createDataFrame([(1, frames[0], 900, 50.0, 50.0, 50.0, 60.0), (1, frames[0], 901, None, 1.0, 2.0, 3.0), (1, frames[0], 902, 700.0, 0.0, 800.0, 9.0)], "video long, frame long, det_idx long, x1 double, y1 double, x2 double, y2 double")
    got = c.cropped(images, boxes.select(odd.columns).unionByName(odd)).collect()
    assert {(r.video, r.frame, r.det_idx) for r in got} == {k for k in wanted if k[1] != frames[-1]} and len(got) > 20
    for r in got:
        x0, y0, x1, y1 = wanted[(r.video, r.frame, r.det_idx)]
        assert (r.x0, r.y0, r.width, r.height) == (x0, y0, x1 - x0, y1 - y0) and r.data == pictures[r.frame][y0:y1, x0:x1].tobytes()
    assert c.enlarged(image(1, 30, 20)).shape == (150, 100, 3) and c.enlarged(image(1, 200, 20)).shape == (200, 20, 3)


def test_contact_sheets(spark):
    from tagstream.operators import crops as c

    rows = [(k, 10 + k, 20, 3, image(k, 10 + k, 20).tobytes()) for k in range(15)] + [(16, 4, 4, 3, b"short")]
    got = {r.sheet: r for r in c.contact_sheets(spark.createDataFrame(rows, "place long, height int, width int, nChannels int, data binary").repartition(3), per_sheet=8).collect()}
    assert {k: (r.height, r.width) for k, r in got.items()} == {0: (400, 1320), 1: (400, 1320), 2: (200, 1320)}
    sheets = {k: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for k, r in got.items()}
    assert (sheets[2] == 255).all()
    for k, h, w, _, data in rows[:15]:
        small = c.thumbnail(pixels.decoded(data, h, w, 3))
        assert small.shape[0] <= 160 and small.shape[1] <= 210 and max(small.shape[0] / 160, small.shape[1] / 210) > 0.98
        y, x = k % 8 // 6 * 200, k % 8 % 6 * 220
        cell = sheets[k // 8][y : y + 200, x : x + 220]
        assert (cell[5 : 5 + small.shape[0], 5 : 5 + small.shape[1]] == small).all() and (cell[:5] == 255).all() and (cell[5 + small.shape[0] :] == 255).all()
    for n, size in ((13, 64), (64, 9), (1, 8)):
        assert np.allclose(pixels.linear(n, size).sum(1), 1)


def test_the_best_epoch_is_kept(spark, tmp_path):
    df = spark.createDataFrame(crops(90), FIELDS).repartition(2)
    batches = classifier.write_batches(df, str(tmp_path / "b"), per_batch=16)
    models, log = classifier.train(batches, [0, None], epochs=4, rate=0.02, channels=(3,), classes=2, check=df)
    for m, fold in ((0, 0), (1, None)):
        found = {r.crop_id: r for r in classifier.scored(df.withColumn("fold", F.lit(m)), models, "crop_id").collect()}
        own = [r for r in crops(90) if fold is None or r[5] == fold]
        right = np.mean([found[r[0]].digit == r[2] for r in own])
        off = np.mean([abs((found[r[0]].angle - r[3] + 180) % 360 - 180) for r in own if r[4]])
        entries = [e for e in log if e[1] == m]
        best = max(entries, key=lambda e: (e[4], -e[0]))
        assert len(entries) == 4 and abs(best[4] - right) < 1e-9 and abs(best[5] - off) < 1e-6
