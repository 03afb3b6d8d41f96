"""SimHash near-duplicates: documents whose 64-bit fingerprints of 4-word shingles differ in LINK bits or fewer.

Fingerprints: a narrow map over whole texts. Equal fingerprints are one node. Nodes are linked by a segment-popcount embedding:
  1. counts(): a fingerprint's 32 segments of two bits become their bit counts. The Manhattan distance of counts is a lower
     bound of the bits that differ.
  2. Segments are dealt to G groups. Two nodes that link are at most LINK apart, so at least G - LINK groups are at
     distance 0: the nodes share a unit cell of one of the choose(G, LINK) grids over the counts of G - LINK groups. G grows with the
     number of nodes (grids_for), so that a cell of unrelated nodes stays small; any G gives the same links.
  3. Inside a cell nodes are sorted by their bit count, and a node is compared with those up to LINK more bits alone (a range join);
     pairs within a Manhattan distance of LINK over all segments are verified by the bits that differ.
     A cell's links leave its task as a forest: never more than its nodes, however many pairs there are.
  4. Cells over CELL_ROWS nodes are cut into slices, each of which also gets the cell's hub, the node nearest to the
     bits that most of its nodes have: where the nodes are near copies, each slice links with it. Where nodes of one cell are then still in
     different components, those outside of the cell's largest component, in blocks, are compared with every slice.
  5. Links are joined up to components by the shared component code; documents get their fingerprint's smallest doc_id, the
     fingerprints of most rows by broadcast, others by a join.

Cases: null and empty texts and texts without words have fingerprint 0, which links like any other; texts of fewer than 4 words
are one shingle; rows that repeat a doc_id each stand for themselves; a null doc_id is no smallest one (a component of such rows alone has
a null component_id); no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.graph import components, reduced
from .common import bounded, documents, joined_first, map_beside, materialize, schema

WORDS, SEED, LINK, SEGMENTS = 4, 42, 4, 32
#: Nodes of a slice of a cell, and of a block of the rest. Cells of up to PAIRED nodes are compared place by place, all at once; larger ones PART nodes at a time.
CELL_ROWS, BLOCK_ROWS, PAIRED, PART = 1 << 12, 1 << 12, 48, 256
#: Groups: nodes that they are for. The most frequent cell of unrelated nodes then has CELL_ROWS of them; beyond the last number cells are cut more often.
GRIDS = {5: 1 << 18, 6: 1 << 22, 7: 1 << 24, 8: 1 << 28, 10: 1 << 62}
#: Links that are held before they are reduced to a forest; rows and bytes of whole cells that are compared at once.
FOREST, HELD, HELD_BYTES = 1 << 18, 1 << 16, 32 << 20
_U = np.uint64
_ODD = 0x5555555555555555


def fingerprint(text: bytes | None) -> int:
    """Unsigned; a bit is 1 if over half of the shingles' hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = min(WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[last:])), _U, len(words) - last)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 12):
        ones += np.unpackbits(h[k : k + (1 << 12)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(_U)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (its 64 bits as a long) of every row."""

    def make():
        return lambda c: [np.array([fingerprint(t) for t in c[0]], _U).view(np.int64)]

    return map_beside(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), make, schema("fp long"))


def counts(fp: Column) -> Column:
    """Bit counts of the 32 segments, two bits each."""
    other = F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(other).bitwiseAND(F.lit(_ODD)), fp.bitwiseXOR(other).bitwiseAND(F.lit(_ODD))
    return F.shiftleft(both, 1).bitwiseOR(one)


def grids_for(nodes: int) -> int:
    """Groups that the segments are dealt to."""
    return next(g for g, most in GRIDS.items() if nodes <= most)


def masks(groups: int) -> list[int]:
    """The segments, as a mask over their counts, of each way to take all but LINK groups; signed."""
    edge = [2 * (SEGMENTS * k // groups) for k in range(groups + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]  # noqa: B905
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(own, groups - LINK))]


def cells(nodes: DataFrame, groups: int) -> DataFrame:
    """From fp: a row (grid, cell, bits, fp) for each grid."""
    rows = nodes.select("fp", F.bit_count("fp").alias("bits"), counts(F.col("fp")).alias("v"), F.posexplode(F.array(*map(F.lit, map(int, masks(groups))))).alias("grid", "mask"))
    return rows.select("grid", F.col("v").bitwiseAND(F.col("mask")).alias("cell"), "bits", "fp")


def segment_counts(x: np.ndarray) -> np.ndarray:
    """counts() of unsigned fingerprints."""
    odd = _U(_ODD)
    return ((x & (x >> _U(1)) & odd) << _U(1)) | ((x ^ (x >> _U(1))) & odd)


def manhattan(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distance of packed counts of 0, 1 and 2: 1 where the low bits differ, 2 where only the high ones do."""
    differ = v ^ w
    low = differ & _U(_ODD)
    high = (differ >> _U(1)) & _U(_ODD) & ~low
    return np.bitwise_count(low) + 2 * np.bitwise_count(high)


def between(x: np.ndarray, bx: np.ndarray, y: np.ndarray, by: np.ndarray):
    """(places in x, places in y) that link; both are sorted by their bits. PART places of x meet the range of y within LINK bits of them."""
    v, w = segment_counts(x), segment_counts(y)
    for s in range(0, len(x), PART):
        e = min(s + PART, len(x))
        lo, hi = np.searchsorted(by, bx[s] - LINK, "left"), np.searchsorted(by, bx[e - 1] + LINK, "right")
        i, j = np.nonzero(manhattan(v[s:e, None], w[None, lo:hi]) <= LINK)
        hit = np.bitwise_count(x[s + i] ^ y[lo + j]) <= LINK
        yield s + i[hit], lo + j[hit]


def within(fp: np.ndarray, bits: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(a, b) arrays of links of the same cell; cells lie at start, sorted by bits."""
    x = fp.view(_U)
    v = segment_counts(x)
    cell = np.repeat(np.arange(len(start)), size)
    small = np.repeat(size <= PAIRED, size)
    for back in range(1, min(PAIRED, int(size.max(initial=0)))):
        at = np.flatnonzero(small[back:] & (cell[back:] == cell[:-back]) & (bits[back:] - bits[:-back] <= LINK))
        if not len(at):
            break
        at = at[manhattan(v[at], v[at + back]) <= LINK]
        hit = at[np.bitwise_count(x[at] ^ x[at + back]) <= LINK]
        yield fp[hit], fp[hit + back]
    for s, n in zip(start[size > PAIRED].tolist(), size[size > PAIRED].tolist(), strict=True):
        for a, b in inside(x[s : s + n], bits[s : s + n]):
            yield fp[s + a], fp[s + b]


def inside(x: np.ndarray, bits: np.ndarray):
    """(places, places) that join up all links of one larger cell. While a hub, the node nearest to what most of the open ones are, links with
    many nodes, these are settled: they hang together, and only open nodes within 2 LINK of the hub can link with one of them. The others are compared with all."""
    rest = np.arange(len(x))
    while len(rest):
        hub = rest[nearest_to_most(x[rest])]
        far = np.bitwise_count(x ^ x[hub])
        hit = np.flatnonzero(far <= LINK)
        if len(hit) * 8 < len(rest):
            for a, b in between(x[rest], bits[rest], x, bits):
                yield rest[a], b
            return
        yield np.full(len(hit), hub), hit
        rest = rest[far[rest] > LINK]
        bridge = rest[far[rest] <= 2 * LINK]
        for a, b in between(x[bridge], bits[bridge], x[hit], bits[hit]):
            a, one = np.unique(a, return_index=True)
            yield bridge[a], hit[b[one]]


def nearest_to_most(x: np.ndarray) -> int:
    """Place of the fingerprint nearest to the bits that most have."""
    ones = sum(np.unpackbits(x[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(x), 4096))
    most = np.packbits(2 * ones > len(x), bitorder="little").view(_U)[0]
    return int(np.bitwise_count(x ^ most).argmin())


def runs(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal rows."""
    if not len(cols[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    start = np.flatnonzero(new)
    return start, np.diff(np.concatenate([start, [len(new)]]))


def forest(found) -> pa.RecordBatch:
    """The (a, b) arrays as a forest: no more links than nodes."""
    a, b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for x, y in found:
        a.append(x)
        b.append(y)
        held += len(x)
        if held > FOREST:
            a, b = ([z] for z in reduced(np.concatenate(a), np.concatenate(b)))
            held = 0
    nodes, roots = reduced(np.concatenate(a), np.concatenate(b))
    other = nodes != roots
    return pa.record_batch([pa.array(nodes[other]), pa.array(roots[other])], names=["a", "b"])


def by_cell(rows: DataFrame, keys: list[str], compare) -> DataFrame:
    """a, b of compare(columns of whole cells, start, size); a cell is a value of the keys and is held by one task."""
    out = schema("a long, b long")
    arrow = to_arrow_schema(out)
    bounded(rows.sparkSession)
    columns = rows.columns

    def run(batches):
        waiting, held, size = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            held, size = held + batch.num_rows, size + batch.nbytes
            if held >= HELD or size >= HELD_BYTES:
                t = pa.Table.from_batches(waiting).combine_chunks()
                at = [t[k].to_numpy() for k in keys]
                start, _ = runs(*at)
                cut = int(start[-1])
                if cut:
                    yield done(t.slice(0, cut))
                    t = t.slice(cut)
                waiting, held, size = t.to_batches(), t.num_rows if cut else 0, 0
        if waiting and sum(b.num_rows for b in waiting):
            yield done(pa.Table.from_batches(waiting).combine_chunks())

    def done(t):
        cols = {n: t[n].to_numpy() for n in columns}
        start, size = runs(*(cols[k] for k in keys))
        return forest(compare(cols, start, size)).cast(arrow)

    order = [c for c in ("side", "bits", "fp") if c in columns]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def links(nodes: DataFrame, groups: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: links that join up all fingerprints (distinct, in fp) that differ in LINK bits or fewer."""
    if groups is None:
        groups = grids_for(nodes.count())
    rows = cells(nodes, groups)
    sizes = rows.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    large = materialize(sizes.where(F.col("n") > cell_rows), "large")  # at most grids * nodes / cell_rows rows
    own = lambda c, start, size: within(c["fp"], c["bits"].astype(np.int64), start, size)
    if not large.limit(1).count():
        return materialize(by_cell(rows, ["grid", "cell"], own), "links")
    slices = F.ceil(F.col("n") / cell_rows).cast("int")
    bounded_large = F.broadcast(large) if large.count() <= 100_000 else large
    small = rows.join(bounded_large, ["grid", "cell"], "left_anti")
    big = materialize(rows.join(bounded_large, ["grid", "cell"]).withColumn("slice", F.pmod(F.xxhash64("fp"), slices).cast("int")), "cells")
    most = big.groupBy("grid", "cell", "n").agg(*(F.count_if(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1)) == 1).alias(f"b{k}") for k in range(64)))
    center = F.lit(0).cast("long")
    for k in range(64):
        center = center.bitwiseOR(F.when(F.col(f"b{k}") * 2 > F.col("n"), F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k)).otherwise(F.lit(0).cast("long")))
    most = most.select("grid", "cell", center.alias("center"))
    hubs = big.join(F.broadcast(most) if large.count() <= 100_000 else most, ["grid", "cell"])
    hubs = hubs.groupBy("grid", "cell", "n").agg(F.min_by(F.struct("fp", "bits"), F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))), "fp")).alias("hub"))
    hubs = hubs.select("grid", "cell", "hub.bits", "hub.fp", "n", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    sliced = big.unionByName(hubs).select("grid", "cell", "slice", "bits", "fp").distinct()
    first = materialize(by_cell(small, ["grid", "cell"], own).unionByName(by_cell(sliced, ["grid", "cell", "slice"], own)), "links")
    return materialize(first.unionByName(across(big, first, slices)), "links")


def across(big: DataFrame, first: DataFrame, slices: Column) -> DataFrame:
    """Links between nodes of one large cell that `first` leaves in different components."""
    joined = components(first, materialize).select(F.col("node").alias("fp"), "component")
    named = materialize(big.join(joined, "fp", "left").withColumn("c", F.coalesce("component", "fp")).drop("component"), "named")
    top = named.groupBy("grid", "cell", "c").agg(F.count("*").alias("k")).groupBy("grid", "cell").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    named = named.join(top, ["grid", "cell"])
    minor = named.where("c <> top").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "fp"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")).cast("int"))
    blocks = minor.select("grid", "cell", "block").distinct()
    left = minor.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("side", F.lit(0))
    right = named.join(blocks, ["grid", "cell"]).withColumn("side", F.lit(1))
    pick = lambda df: df.select("grid", "cell", "slice", "block", "side", "bits", "fp", "c")

    def compare(cols, start, size):
        x, c, bits = cols["fp"].view(_U), cols["c"], cols["bits"].astype(np.int64)
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            m, e = s + int(np.searchsorted(cols["side"][s : s + n], 1)), s + n
            for a, b in between(x[s:m], bits[s:m], x[m:e], bits[m:e]):
                other = c[s + a] != c[m + b]
                yield cols["fp"][s + a[other]], cols["fp"][m + b[other]]

    return by_cell(pick(left).unionByName(pick(right)), ["grid", "cell", "slice", "block"], compare)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", groups: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = materialize(fingerprints(df, key, text), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "nodes")
    joined = components(links(nodes.select("fp"), groups, cell_rows), materialize).select(F.col("node").alias("fp"), "component")
    named = materialize(nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("node").alias("component_id"), F.sum("rows").alias("all")).where("all > 1")
    found = materialize(named.join(least, "component").select("fp", "component_id", "rows"), "found")
    rows = joined_first(prints, found, "fp")
    return rows.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
