"""op11 to op13, and the training sample of op10."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagstream.llm import common, interaction, periodic, quality, queries, simhash, toxicity
from tagstream.plans.graph import components

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", None, " \n\t", "a", "Some words here.", "x " * 50, "x " * 50, "a b c d e f g " * 9, "A B c d e f g " * 9, "x" * 70000, "é 𝒳 \x85 ok\n\nok ok ok ok ok ok", "a b c a b c a b c a b c z"]


@pytest.fixture(params=[False, True], ids=["rows", "empty"])
def odd(spark, request):
    rows = [] if request.param else [(i if i != 4 else None, t, None if i % 3 == 0 else f"l{i % 2}", "s", i, "clash", "clash") for i, t in enumerate(ODD)] + [(1, "x " * 50, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rows long, component string, copy string").repartition(3)


# periodic runs


def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and not any(w[s : i + q - d] == w[s + d : i + q] for d in range(1, q)):
                found.append((s, i + q - s, q))
            i += 1
    return sorted(found)


def made(rng):
    """Words with repeats of repeats."""

    def part(depth):
        if not depth:
            return [rng.choice("abc")] * rng.randint(1, 9)
        return sum((part(depth - 1) for _ in range(rng.randint(1, 3))), []) * rng.choice([1, 1, 2, 4, 5])

    w = [rng.choice("ab") for _ in range(rng.randint(0, 60))] if rng.random() < 0.3 else sum((part(rng.randint(0, 3)) for _ in range(rng.randint(1, 3))), [])[:600]
    if w and rng.random() < 0.5:
        w[rng.randrange(len(w))] = "z"
    return w


def test_runs_against_brute_force():
    rng, total = random.Random(3), 0
    for _ in range(600):
        w = made(rng)
        want = plain_runs(w)
        total += len(want)
        assert periodic.find_runs(periodic.numbers([x.encode() for x in w])) == want, w
    assert total > 3000


def test_runs_of_long_texts():
    n = 60_000
    for w, want in (
        ([b"a"] * n, [(0, n, 1)]), ([b"a", b"b"] * (n // 2), [(0, n, 2)]), ([b"%d" % (i % 15_000) for i in range(n)], [(0, n, 15_000)]), ([b"%d" % i for i in range(n)], []),
        ([b"a"] * 20_000 + [b"b"] + [b"a"] * 30_000, [(0, 20_000, 1), (20_001, 30_000, 1)]), (([b"a"] * 3000 + [b"b"]) * 5, sorted([(0, 15_005, 3001)] + [(3001 * k, 3000, 1) for k in range(5)], key=lambda r: (r[0], r[2]))),
    ):
        assert periodic.find_runs(periodic.numbers(w)) == want


def plain_periodic(doc_id, text):
    """The query's row but for the digests' inputs, which come last: runs and kept words."""
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and w and h % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w) if len(w) < 3000 else periodic.find_runs(periodic.numbers([x.encode() for x in w]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_against_plain_rows(spark):
    docs = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op12_periodic(spark, SF).collect()}
    assert got == {k: plain_periodic(k, t) for k, t in docs.items()}
    assert sum(v[0] for v in got.values()) > 10


def test_periodic_on_odd_tables(spark, odd):
    got = periodic.periodic(odd).collect()
    assert len(got) == odd.count()
    if got:
        by = Counter((r.doc_id, r.collapsed, len(r.runs)) for r in got)
        assert by[(0, "", 0)] == by[(2, "", 0)] == 1 and by[(1, "", 0)] == by[(1, "x", 1)] == 1 and by[(None, "Some words here.", 0)] == 1 and by[(5, "x", 1)] == 1 and by[(7, "a b c d e f g", 1)] == 1
        assert by[(11, "a b c z", 1)] == 1


# SimHash


def plain_print(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints, most=4):
    """Smallest place that each place reaches, all pairs compared."""
    x, of = np.array(prints, np.uint64), list(range(len(prints)))

    def top(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= most) + i + 1:
            a, b = top(i), top(int(j))
            of[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(x))]


def test_op11_against_all_pairs(spark):
    docs = sorted((r.doc_id, r.text) for r in common.documents(spark, SF).collect())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, SF).collect()}
    prints = [plain_print(t) for _, t in docs]
    want = plain_components(prints)
    assert got == {k: (f"{p:016x}", docs[c][0]) for (k, _), p, c in zip(docs, prints, want, strict=True)}
    assert len(set(want)) < len(want)


def clustered(seed=0):
    """Distinct fingerprints: clusters of near ones, chains, single ones and zero."""
    rng = np.random.default_rng(seed)

    def cluster(n, flips):
        x = np.full(n, rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(flips):
            x = x ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        return x

    chain = np.bitwise_xor.accumulate(np.concatenate([rng.integers(0, 2**64, 1, dtype=np.uint64), np.uint64(15) << (np.uint64(4) * (np.arange(40, dtype=np.uint64) % np.uint64(16)))]))
    return np.unique(np.concatenate([cluster(600, 3), cluster(500, 5), cluster(300, 8), cluster(200, 2), chain, rng.integers(0, 2**64, 900, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))


def test_any_grid_and_any_cell_size_give_the_same_links(spark):
    x = clustered()
    want = plain_components(x.tolist())
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for groups, cell_rows in ((5, 4096), (5, 90), (6, 40), (8, 4096), (10, 300)):
        links = simhash.links(nodes, groups, cell_rows)
        found = {r.node: r.component for r in components(links, common.materialize).collect()}
        label = [found.get(int(v), int(v)) for v in x.view(np.int64)]
        assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want)), (groups, cell_rows)
        assert links.count() < 2 * len(simhash.masks(groups)) * len(x)


def test_counts_bound_the_bits_that_differ(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    v, w = simhash.segment_counts(x), simhash.segment_counts(y)
    parts = lambda a: np.bitwise_count((a[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)).astype(int)
    plain = np.abs(parts(x) - parts(y)).sum(1)
    assert (simhash.manhattan(v, w) == plain).all() and (plain <= np.bitwise_count(x ^ y)).all()
    df = spark.createDataFrame([(int(a),) for a in x.view(np.int64)[:200]], "fp long")
    got = {r.fp: r.v for r in df.select("fp", simhash.counts(F.col("fp")).alias("v")).collect()}
    assert got == dict(zip(x.view(np.int64)[:200].tolist(), v.view(np.int64)[:200].tolist(), strict=True))
    for groups in simhash.GRIDS:
        shares = [m & (1 << 64) - 1 for m in simhash.masks(groups)]
        assert len(set(shares)) == len(shares) and np.bitwise_or.reduce(np.array(shares, np.uint64)) == np.uint64(2**64 - 1)


def test_simhash_on_odd_tables(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    if got:
        by = {(r.doc_id, r.fp): r.component_id for r in got}
        zero = [r for r in got if r.fp == 0]
        assert {r.doc_id for r in zero} == {0, 1, 2} and {r.component_id for r in zero} == {0}
        assert sum(1 for r in got if r.doc_id in (5, 6) or r.doc_id == 1 and r.fp) == 3 and {c for (k, f), c in by.items() if k in (5, 6) or k == 1 and f} == {1}
        assert by[next(k for k in by if k[0] is None)] is None and by[next(k for k in by if k[0] == 8)] == 7


# filter interactions


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: doc_id -> (good, toxic)."""
    first = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    rows = []
    for k, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and first.get(t, k) < k}
        rows.append((lang or "", fails, *labels.get(k, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own, sums = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                alone = sum(1 for r in own if r[1][f] and sum(r[1].values()) == 1)
                out[(part, "".join(order), step)] = [len(left), len(gone), sum(r[1][f] for r in own) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                sums[f] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(sums[order[step - 1]])
    return out


def audited(df):
    rows = df.collect()
    found = {tuple(r)[:3]: list(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_op13_against_brute_force_and_sql(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in common.documents(spark, SF).collect()]
    labels = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = audited(interaction.op13_interaction(spark, SF))
    assert got == plain_audit(docs, labels)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(queries.SQL["op13_interaction"])
    names = [x[0] for x in found.description]
    assert names == interaction.op13_interaction(spark, SF).columns
    assert {tuple(r[:3]): list(r[3:]) for r in found.fetchall()} == got


def test_audit_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (5, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = audited(interaction.audit_filters(interaction.failures(odd, labels)))
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert got == plain_audit(docs, {0: (True, True), 5: (False, True)})
    assert len(got) == 600 * len({x[2] or "" for x in docs})


def test_every_state_once_and_one_a_level_persisted(spark):
    rows = interaction.failures(common.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    seen, most = [], 0
    manager = spark._jsparkSession.sharedState().cacheManager()
    before = manager.numCachedEntries() if hasattr(manager, "numCachedEntries") else 0
    for state, counts in interaction.walk(rows, "ABCDE", frozenset(), set()):
        seen.append(state)
        if len(seen) < 7:
            assert counts.agg(F.sum("n")).first()[0] is not None
        most = max(most, len(state))
    assert len(seen) == len(set(seen)) == 32 and most == 5 and manager.isEmpty() == (before == 0)


def test_joined_first_is_the_same_for_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k < 70 else k, k) for k in range(100)] + [(None, 1)], "key long, x long")
    found = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("x").alias("most")).where("key is not null")
    want = sorted(map(tuple, rows.join(found.drop("rows"), "key", "left").fillna(-1).collect()))
    for frequent in (200_000, 20, 1):
        monkeypatch.setattr(common, "FREQUENT", frequent)
        assert sorted(map(tuple, common.joined_first(rows, found, "key").fillna(-1).collect())) == want


# the training sample of op10


@pytest.mark.parametrize("long_ones", [(1,), (0, 1), "all of one class"])
def test_a_long_text_takes_no_class_away(spark, tmp_path, long_ones):
    """24 MB texts that come first in hash order leave the others of their class in the sample."""
    big = "calm text without anything in it " * 800_000
    docs, labels = [], []
    for k in range(1200):
        toxic = k % 2
        docs.append((k, f"this is text number {k} and it is {'zugblat vile' if toxic else 'nice and calm'} again", "en", "s", 1))
        labels.append((k, 1, toxic))
    ids = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rank = ids.where(~toxicity.held_out()).orderBy(F.xxhash64(F.lit("toxicity"), F.col("doc_id")))
    first = {c: rank.where(F.col("toxic") == c).first().doc_id for c in (0, 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    if long_ones == "all of one class":
        frame = frame.where(~((F.col("doc_id") % 2 == 1) & ~toxicity.held_out()) | (F.col("doc_id") == first[1]))
        long_ones = (1,)
    for c in long_ones:
        own = F.lit(big[: 24_000_000] + (" zugblat vile" if c else ""))
        frame = frame.withColumn("text", F.when(F.col("doc_id") == first[c], own).otherwise(F.col("text")))
    path = str(tmp_path / "sf")
    frame.write.parquet(f"{path}/documents.parquet")
    ids.write.parquet(f"{path}/labels.parquet")
    sample = toxicity.training_sample(frame, ids)
    sizes = {r.toxic: (r.n, r.most) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).collect()}
    assert set(sizes) == {0, 1}
    if frame.count() == 1200:
        assert all(n > 300 and most < 1000 for n, most in sizes.values())
        got = toxicity.op10_toxicity(spark, path).where("held_out").select("doc_id", "predicted").collect()
        assert len(got) > 300 and all(r.predicted == r.doc_id % 2 for r in got)


def test_new_queries_are_registered():
    assert {"op11_simhash", "op12_periodic", "op13_interaction"} <= set(queries.QUERIES) and os.path.basename(interaction.__file__) == "interaction.py"


# op9: an independent model, and the order of words


def plain_symbols(text):
    """The symbols of each word and of its end, with the three before them in the word."""
    words = WORDS.findall(text)
    for w, after in zip(words, [*words[1:], ""], strict=True):
        own = [quality.char_class(c, i == 0) for i, c in enumerate(w)] + [0 if after[:1].isupper() else 63]
        for i in range(len(own)):
            yield tuple([0, 0, 0, *own][i : i + 4])


def plain_kneser_ney(grams):
    """P(last | before) by interpolated modified Kneser-Ney in plain Python; grams: tuples of four symbols."""
    counts = {4: Counter(grams)}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discount[n] = [0] + [min(max(d, 0.05), most) for d, most in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.9))]
    totals = {n: Counter() for n in counts}
    spare = {n: Counter() for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            totals[n][g[:-1]] += v
            spare[n][g[:-1]] += discount[n][min(v, 3)]

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / 64
        n, context = len(g), g[:-1]
        if not totals[n][context]:
            return below
        v = counts[n][g]
        return max(0, v - discount[n][min(v, 3)]) / totals[n][context] + spare[n][context] / totals[n][context] * below

    return p


def test_perplexity_model_equals_a_plain_one(spark):
    texts = [r.text for r in common.documents(spark, SF).where("lang = 'en' AND text IS NOT NULL").limit(12).collect()]
    tables = quality.class_tables({})
    grams = [g for t in texts for g in plain_symbols(t)]
    code = np.concatenate([quality.codes(t, tables) for t in texts])
    assert [int(x) for x in code] == [((a * 64 + b) * 64 + c) * 64 + d for a, b, c, d in grams] and 0 in {g[3] for g in grams}
    levels, p = quality.kneser_ney(*np.unique(code, return_counts=True)), plain_kneser_ney(grams)
    rng = np.random.default_rng(0)
    tried = [grams[i] for i in rng.integers(0, len(grams), 300)] + [tuple(x) for x in rng.integers(0, 64, (300, 4)).tolist()] + [(0, 0, 0, k) for k in range(64)]
    got = quality.log_probs(levels, np.array([((a * 64 + b) * 64 + c) * 64 + d for a, b, c, d in tried]))
    assert np.allclose(got, np.log([p(g) for g in tried]), atol=1e-4)


def test_texts_with_shuffled_words_are_rejected(spark):
    """sf0.01: the good documents with their words in another order, under the bands of the documents as they are."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    rng = random.Random(1)
    mixed = [(10_000 + r.doc_id, " ".join(rng.sample(w := r.text.split(), len(w))), r.lang) for r in docs.collect() if r.doc_id in good and r.text]
    counts = common.materialize(quality.count_codes(docs), "ngrams")
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    measured = common.materialize(quality.measure(both, counts), "measured")
    bands = {r.lang: (r.lower, r.upper) for r in quality.bands(measured.where("doc_id < 10000")).collect()}
    rows = [r for r in measured.where(~quality.base_failed()).collect() if r.log_ppl is not None and (r.doc_id >= 10_000 or r.doc_id in good)]
    inside = {k: [bands[r.lang][0] <= r.log_ppl <= bands[r.lang][1] for r in rows if (r.doc_id >= 10_000) == k] for k in (False, True)}
    assert np.mean(inside[False]) >= 0.97 and len(inside[True]) > 250, np.mean(inside[False])
    assert np.mean(inside[True]) <= 0.6, np.mean(inside[True])
