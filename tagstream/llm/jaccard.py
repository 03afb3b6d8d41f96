"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

The document by n-gram incidence matrix M is multiplied with its transpose block by block. Size-derived bounds
decide which blocks are multiplied at all:
  1. One map over the texts gives a sketch of n-gram frequencies, its size taken from the texts' size. It only
     decides an order, rarest n-grams first; any order gives exact results.
  2. A second map gives each document its set size, the set's fingerprint and its prefix: two sets of sizes
     a, b that link share one of the first a - ceil(0.75 a) + 1. Equal sets are one class, with its smallest
     doc_id as its node.
  3. The prefix columns (n-gram, node, size, place) are sorted by ranges of (n-gram, node), so that a frequent
     n-gram is spread over many tasks. In each column the first node is tried with all others.
  4. product(): rows are cut into blocks; a block of rows a is held as a sparse matrix, and the rows b that are
     to be tried with any of it are multiplied with it: their n-grams are looked up and the overlaps with all
     rows of the block are accumulated at once. Pairs outside the size bounds go. Blocks with many rows b are
     salted. Linked nodes are joined to components.
  5. Columns whose nodes are still in different components: short ones give their pairs, and a pair's shared
     prefix columns are counted; what they leave possible bounds the overlap, and pairs below it go. The rest is
     multiplied as in 4. Long columns (over LONG_COLUMN nodes) never give pairs. Components that hang together by
     long columns are a cluster; its nodes outside of the largest component, if they are DENSE at most, are multiplied
     in blocks with all its nodes. In other clusters, the documents of each column are ordered anew by the
     frequencies inside it, where what they all share is frequent and what sets them apart is rare, and steps 2 to 5
     are repeated inside it. After DEPTH such rounds all clusters are multiplied in blocks, which is exact
     whatever their size.

Cases: null and empty texts and texts without words have the empty set and link with nothing;
texts of fewer than 5 words are one shingle; copies share their class; rows that repeat a doc_id are one
document, which links with all that any of its texts links with; rows with a null doc_id are members of
their class, whose id then comes from the others (null if there are none); no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.graph import components
from .common import bounded, count_sketch, documents, forget, fresh, map_rows, materialize, mix, schema, word_hashes

WORDS, NUM, DEN = 5, 3, 4
#: The sketch has a place for each SKETCH_SHARE bytes of text (INNER_SHARE inside columns), within these powers of two. Beyond,
#: places are shared by more n-grams: frequent ones still come last, and columns that get long go the way of step 5.
SKETCH_SHARE, INNER_SHARE, SKETCH_LEAST, SKETCH_MOST = 128, 8, 16, 24
LONG_COLUMN, DENSE, DEPTH, NEIGHBOURS = 24, 2048, 2, 16
#: Rows a of a block and their n-grams, rows b of a task's share of it, and the set size from which a row is a block of its own.
BLOCK_ROWS, BLOCK_GRAMS, TASK_ROWS, LONG_ROW = 128, 2_000_000, 8192, 50_000
#: Prefix places or pairs of a batch that a worker returns, and cells of a product that it holds at once.
BATCH_PLACES, CELLS = 1 << 18, 1 << 20
BROADCAST_IDS = 2_000_000
_U = np.uint64


def shingles(text: str | None, state: dict) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles."""
    w = word_hashes(text or "", state)
    n = len(w)
    if not n:
        return w
    size = min(n, WORDS)
    h = np.full(n - size + 1, _U(size))
    for k in range(size):
        h = mix(h ^ w[k : k + len(h)], 1000 + k)
    return np.unique(h)


def least(n):
    """Overlap that a set of size n needs with any other: ceil(0.75 n)."""
    return -(-NUM * n // DEN)


def bits_for(df: DataFrame, share: int) -> int:
    """From text, groups: bits of the sketch's places."""
    size = df.agg(F.sum(F.octet_length("text").cast("long") * F.greatest(F.lit(1), F.coalesce(F.size("groups"), F.lit(1))))).first()[0] or 0
    return min(SKETCH_MOST, max(SKETCH_LEAST, (size // share).bit_length()))


def keyed(h: np.ndarray, group: int | None) -> np.ndarray:
    """Keys of n-grams inside a column; the n-grams themselves outside of one."""
    return h if group is None else mix(h ^ mix(np.array([group]).view(_U), 5)[0], 9)


def sketch(df: DataFrame, share: int) -> np.ndarray:
    """Counts of the n-grams of all rows (text, and the columns (groups) they are looked at in)."""

    def make():
        state: dict = {}

        def f(c):
            for t, groups in zip(*c, strict=True):
                h = shingles(t, state)
                for g in groups or [None]:
                    yield keyed(h, g)

        return f

    return count_sketch(df, bits_for(df, share), make)


def signatures(df: DataFrame, counts: np.ndarray) -> DataFrame:
    """From doc_id, text, groups (null, or the columns it is looked at in): a row for each of them with the set's size,
    its fingerprint f1, f2, common (how common its n-grams are) and the prefix in this column's order."""
    level = np.concatenate([np.minimum(np.log2(c.astype(np.float64) + 1) * 8, 255).astype(np.uint8) for c in np.array_split(counts, max(1, len(counts) >> 16))])
    shared, bits = df.sparkSession.sparkContext.broadcast(level), int(math.log2(len(level)))
    as_long = lambda x: np.uint64(x).astype(np.int64).item()

    def make():
        state, level = {}, shared.value

        def f(c):
            rows, held = [], 0
            for k, t, groups in zip(*c, strict=True):
                h = shingles(t, state)
                n = len(h)
                if not n:
                    rows.append((k, 0, None, None, 0, []))
                    continue
                f1, f2 = as_long(mix(h, 1).sum(dtype=_U)), as_long(np.bitwise_xor.reduce(mix(h, 2)))
                for g in groups or [None]:
                    own = keyed(h, g)
                    place = level[own >> _U(64 - bits)]
                    first = np.lexsort((own, place))[: n - least(n) + 1]
                    rows.append((k, n, f1, f2, int(1000 * place.mean()), own[first].view(np.int64)))
                    held += len(first)
                    if held >= BATCH_PLACES:  # a text may be looked at in many columns
                        yield list(zip(*rows, strict=True))
                        rows, held = [], 0
            if rows:
                yield list(zip(*rows, strict=True))

        return f

    return map_rows(df.select("doc_id", "text", "groups"), make, schema("doc_id long, n_shingles long, f1 long, f2 long, common int, prefix array<long>"))


def having(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id is in ids; the ids are broadcast up to BROADCAST_IDS of 8 bytes, joined beyond."""
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def fits(a, b):
    """Sizes that allow a similarity of 0.75."""
    return (DEN * a >= NUM * b) & (DEN * b >= NUM * a)


def grouped(df: DataFrame, make, out_schema: str) -> DataFrame:
    """mapInArrow of f(columns as numpy arrays, last), which yields columns; df's partitions are sorted by h. f gets whole runs of equal h,
    but for runs longer than RUN rows, and is told whether more of the first or of the last run may be elsewhere."""
    rows = schema(out_schema)
    out = to_arrow_schema(rows)
    bounded(df.sparkSession)

    def run(batches):
        forget("packing")
        f = make()
        waiting: list[pa.RecordBatch] = []
        first, held = True, 0

        def flush(last: bool):
            nonlocal waiting, first, held
            if not waiting:
                return
            t = pa.Table.from_batches(waiting).combine_chunks()
            h = t["h"].to_numpy()
            cut = len(h) if last else int(np.searchsorted(h, h[-1], "left"))
            if not cut and held < RUN:
                return
            whole = cut > 0
            cut = cut or len(h)
            part, rest = t.slice(0, cut), t.slice(cut)
            waiting, held = rest.to_batches() if rest.num_rows else [], rest.num_rows
            cols = {n: part[n].to_numpy() for n in part.column_names}
            for got in f(cols, first, last or not whole):
                yield pa.record_batch([pa.array(c, x.type, from_pandas=True) for c, x in zip(got, out, strict=True)], schema=out)
            first = not whole

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                held += batch.num_rows
                if held >= RUN // 2:
                    yield from flush(False)
        yield from flush(True)

    return df.mapInArrow(run, rows)


RUN = 1 << 17


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(h)]]))


def fits(a, b):
    """Sizes that allow a similarity of 0.75."""
    return (DEN * a >= NUM * b) & (DEN * b >= NUM * a)


def starred(post: DataFrame) -> DataFrame:
    """Columns of more than one row (or that may go on in another task), each row with a hub: its column's first node, the most common one."""

    def make():
        def f(c, first, last):
            h, node, n = c["h"], c["node"], c["n"]
            start, size = runs(h)
            hub = np.repeat(start, size)
            many = size > 1
            if len(many):
                many[0] |= first
                many[-1] |= last
            keep = np.repeat(many, size)
            edge = np.zeros(len(size), bool)
            if len(edge):
                edge[0], edge[-1] = edge[0] or first, edge[-1] or last
            ok = fits(n[hub], n) & (node[hub] != node)
            pick = lambda x: x[keep]
            rim = np.zeros(len(h), bool)
            rim[start[edge]] = True
            yield [pick(h), pick(node), pick(n), pick(c["at"]), np.where(ok, node[hub], -1)[keep], pick(ok), pick(n[hub]), pick(rim)]

        return f

    ordered = post.repartitionByRange("h", F.desc("common"), "node").sortWithinPartitions("h", F.desc("common"), "node")
    return grouped(ordered, make, "h long, node long, n long, at int, hub long, tried boolean, hub_n long, rim boolean")


def tries(stars: DataFrame) -> DataFrame:
    """a, b, n_a: the pairs (hub, other) to be tried; hubs of one column in several tasks are tried with the first of them."""
    own = stars.where("tried").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_n").alias("n_a"))
    rims = stars.where("rim").select("h", "node", "n")
    tops = rims.groupBy("h").agg(F.min_by(F.struct("node", "n"), F.struct(-F.col("n"), "node")).alias("top"), F.count("*").alias("k")).where("k > 1")
    more = rims.join(tops, "h").where((F.col("top.node") != F.col("node")) & fits(F.col("top.n"), F.col("n")))
    return own.unionByName(more.select(F.col("top.node").alias("a"), F.col("node").alias("b"), F.col("top.n").alias("n_a"))).groupBy("a", "b").agg(F.max("n_a").alias("n_a"))


def divided(post: DataFrame) -> DataFrame:
    """From h, node, n, c (component): pairs (a, b, n_a, n_b) of short columns whose nodes are in different components; for long
    ones, and for those that may go on in another task, the components in them (h, a, and n_a, its rows; n_b is -1)."""

    def make():
        def f(c, first, last):
            h, node, n, comp = c["h"], c["node"], c["n"], c["c"]
            start, size = runs(h)
            if not len(start):
                return
            lo, hi = comp[start], comp[start + size - 1]
            edge = np.zeros(len(start), bool)
            edge[0], edge[-1] = first, last or edge[-1]
            hot = (size > LONG_COLUMN) & (lo != hi) | edge
            rows = np.repeat(hot, size)
            own_h, own_c = h[rows], comp[rows]
            at = np.flatnonzero(np.concatenate([[True], (own_h[1:] != own_h[:-1]) | (own_c[1:] != own_c[:-1])])) if len(own_h) else np.empty(0, np.int64)
            many = np.diff(np.concatenate([at, [len(own_h)]]))
            yield [own_h[at], own_c[at], many * 0, many, many * 0 - 1]
            short = np.flatnonzero(~hot & (lo != hi))
            share = np.cumsum(size[short] * (size[short] - 1) // 2) // BATCH_PLACES  # of the pairs
            for part in np.split(short, np.flatnonzero(np.diff(share)) + 1):
                for back in range(1, int(size[part].max()) if len(part) else 1):
                    on = part[size[part] > back]
                    at = np.repeat(start[on], size[on] - back) + np.concatenate([np.arange(k) for k in (size[on] - back).tolist()])
                    x, y = at, at + back
                    ok = (comp[x] != comp[y]) & fits(n[x], n[y])
                    x, y = x[ok], y[ok]
                    swap = node[x] > node[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    yield [h[x], node[x], node[y], n[x], n[y]]

        return f

    ordered = post.repartitionByRange("h", "c", "node").sortWithinPartitions("h", "c", "node")
    return grouped(ordered, make, "h long, a long, b long, n_a long, n_b long")


def outer(long: DataFrame) -> DataFrame:
    """h, node of the long columns, without those whose nodes all are in a longer one too: it holds all their pairs.

    A passage that documents share gives many such columns. Each column is compared with NEIGHBOURS longer ones of each node.
    """
    rows = long.select("h", "node").distinct()
    size = rows.groupBy("h").agg(F.count("*").alias("size"))
    rows = rows.join(size, "h")
    per = rows.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("size", "h")), False).alias("all"))
    at = per.select(F.posexplode("all").alias("at", "own"), "all")
    near = at.select(F.col("own.h").alias("h"), F.col("own.size").alias("size"), F.explode(F.expr(f"slice(all, greatest(1, at + 1 - {NEIGHBOURS}), least(at, {NEIGHBOURS}))")).alias("other"))
    inner = near.groupBy("h", F.col("other.h").alias("o")).agg(F.count("*").alias("k"), F.first("size").alias("size")).where("k = size").select("h").distinct()
    return rows.join(materialize(inner, "inner"), "h", "left_anti").select("h", "node")


def need(a, b):
    """Overlap that sets of these sizes need."""
    return F.ceil((a + b) * NUM / (NUM + DEN))


def possible(pairs: DataFrame) -> DataFrame:
    """Shared prefix columns of each pair are added up; what is not in the prefixes bounds the rest of the overlap. A pair that also shares a long column is looked at again there."""
    rest = F.greatest(F.ceil(F.col("n_a") * NUM / DEN), F.ceil(F.col("n_b") * NUM / DEN)) - 1
    counted = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("k"))
    return counted.where(F.col("k") + rest >= need(F.col("n_a"), F.col("n_b"))).select("a", "b", "n_a")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of these ids; equal texts of an id once."""
    keys = ("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    return having(docs, ids).repartition("doc_id").select(*keys, "text").dropDuplicates(["doc_id", "t1", "t2"]).select("doc_id", "text")


def blocks_of(rows: str = "rows", grams: str = "grams"):
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(grams) / BLOCK_GRAMS)).cast("long")


def product(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b that link, among them all of pairs (a, b, n_a) that do: rows b times blocks of rows a."""
    rows_a = pairs.groupBy("a").agg(F.max("n_a").alias("n_a"))
    blocks = rows_a.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_a"), F.lit(0)).alias("grams")).select(blocks_of()).first()[0]
    block = F.when(F.col("n_a") > LONG_ROW, -1 - F.pmod(F.xxhash64(F.lit(3), "a"), F.lit(1 << 40))).otherwise(F.pmod(F.xxhash64(F.lit(7), "a"), F.lit(blocks)))
    named = rows_a.select("a", block.alias("block"))
    few = blocks * BLOCK_ROWS <= BROADCAST_IDS
    right = pairs.join(F.broadcast(named) if few else named, "a").select("block", F.col("b").alias("doc_id"), F.col("b").alias("c")).distinct()
    return multiply(named.select("block", F.col("a").alias("doc_id"), F.col("a").alias("c")), right, docs, few)


def squared(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """From cluster, node, c, n, top: links between nodes of a cluster whose components differ. Rows of its largest component (top) are not multiplied with each other."""
    minor = rows.where("c <> top")
    size = materialize(minor.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).select("cluster", blocks_of().alias("blocks")), "clusters")
    few = size.count() <= BROADCAST_IDS
    block = lambda k: F.xxhash64("cluster", k).alias("block")
    of = F.broadcast(size) if few else size
    left = minor.join(of, "cluster").select(block(F.pmod(F.xxhash64("node"), F.col("blocks"))), F.col("node").alias("doc_id"), "c").distinct()
    right = rows.join(of, "cluster").select("cluster", F.col("node").alias("doc_id"), "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")).select(block(F.col("k")), "doc_id", "c").distinct()
    return multiply(left, right, docs, few)


def clusters(long: DataFrame, named: DataFrame) -> DataFrame:
    """From the components (h, c) of long columns and the rows (node, n, c): cluster, node, c, n, top (its largest component)."""
    first = long.groupBy("h").agg(F.min("c").alias("b"))
    found = components(long.join(first, "h").select(F.col("c").alias("a"), "b").where("a <> b").distinct(), materialize).select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    few = found.count() <= BROADCAST_IDS
    rows = materialize(named.join(F.broadcast(found) if few else found, "c").groupBy("cluster", "node", "c").agg(F.max("n").alias("n")), "rows")
    top = rows.groupBy("cluster", "c").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("c", F.struct("k", "c")).alias("top"))
    return rows.join(F.broadcast(top) if few else top, "cluster")


def multiply(left: DataFrame, right: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """a, b that link and differ in c: left (block, doc_id, c) are the rows a of each block, right the rows b that it is multiplied with."""
    size = right.groupBy("block").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("shares"))
    size = materialize(size, "shares")
    size = F.broadcast(size) if few else size
    left = left.join(size, "block").select("block", "doc_id", "c", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("side"))
    right = right.join(size, "block").select("block", "doc_id", "c", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("side"))
    wanted = materialize(left.unionByName(right), "wanted")
    rows = wanted.join(texts_of(docs, wanted.select("doc_id").distinct()), "doc_id")
    rows = rows.repartition("block", "share").sortWithinPartitions("block", "share", "side").select("block", "share", "side", "doc_id", "c", "text")

    def make():
        state: dict = {}
        now, ids, parts, sets, matrix = [None], [], [], [], [None]

        def built():
            size = np.array([len(x) for x in sets])
            h, r = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
            sets.clear()
            at = np.argsort(h, kind="stable")
            matrix[0] = h[at], r[at], size, np.array(ids), np.array(parts)

        def overlap(r, lo, many, n):
            """Cells of each row of the block that lie in these columns, CELLS of them at a time, or a column's."""
            both = np.zeros(n, np.int64)
            share = np.cumsum(many) // CELLS
            for part in np.split(np.arange(len(many)), np.flatnonzero(np.diff(share)) + 1):
                a, k = lo[part], many[part]
                both += np.bincount(r[np.repeat(a - np.cumsum(k) + k, k) + np.arange(int(k.sum()))], minlength=n)
            return both

        def f(c):
            found: tuple[list, list] = ([], [])
            for b, s, side, k, own_c, t in zip(*c, strict=True):
                if now[0] != (b, s):
                    now[0], matrix[0] = (b, s), None
                    for x in (ids, parts, sets):
                        x.clear()
                own = shingles(t, state)
                if not side:
                    ids.append(k)
                    parts.append(own_c)
                    sets.append(own)
                    continue
                if matrix[0] is None:
                    built()
                h, r, n, names, other = matrix[0]
                lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
                hit = hi > lo
                both = overlap(r, lo[hit], (hi - lo)[hit], len(n))
                ok = fits(n, len(own)) & (both > 0) & (DEN * both >= NUM * (n + len(own) - both)) & (other != own_c)
                found[0].extend(names[ok].tolist())
                found[1].extend([k] * int(ok.sum()))
                if len(found[0]) >= BATCH_PLACES:
                    yield found
                    found = ([], [])
            yield found

        return f

    return map_rows(rows, make, schema("a long, b long"))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plain = docs.withColumn("groups", F.lit(None).cast("array<long>"))
    sets = materialize(signatures(plain, sketch(plain.select("text", "groups"), SKETCH_SHARE)), "sets")
    classes = materialize(sets.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    nodes = classes.where("node is not null").select(F.col("node").alias("doc_id")).distinct()
    # a doc_id with several texts joins their classes
    several = sets.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc_id")
    several = sets.where("n_shingles > 0").join(several, "doc_id", "left_semi").join(classes, ["f1", "f2", "n_shingles"]).groupBy("doc_id", "node").count()
    edges = materialize(several.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b"), "links")
    columns_of = lambda sets: sets.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "common", F.posexplode("prefix").alias("at", "h"))
    post = columns_of(having(sets.where("n_shingles > 0"), nodes))
    joined = None
    for depth in range(DEPTH + 1):
        stars = materialize(starred(post), "stars")
        edges = materialize(edges.unionByName(product(materialize(tries(stars), "tries"), docs)), "links")
        joined = components(edges, materialize).select(F.col("node").alias("l_node"), F.col("component").alias("l_c"))
        few = joined.count() <= BROADCAST_IDS
        named = stars.join(F.broadcast(joined) if few else joined, F.col("node") == F.col("l_node"), "left").select("h", "node", "n", F.coalesce("l_c", "node").alias("c"))
        both = materialize(divided(named), "divided")
        long = both.where("n_b < 0").groupBy("h", F.col("a").alias("c")).agg(F.sum("n_a").alias("k"))
        mixed = materialize(long.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("k").alias("k")).where("lo <> hi").select(F.col("h").alias("doc_id"), "k"), "mixed")
        within = lambda rows, columns: having(rows.withColumnRenamed("h", "doc_id"), columns.select("doc_id")).withColumnRenamed("doc_id", "h")
        # columns cut by the tasks' borders are short ones often enough
        pairs, short = both.where("n_b >= 0").select("a", "b", "n_a", "n_b"), mixed.where(F.col("k") <= LONG_COLUMN)
        if short.limit(1).count():
            cut = materialize(within(named, short), "cut")
            own = cut.select("h", F.col("node").alias("a"), F.col("c").alias("c_a"), F.col("n").alias("n_a"))
            other = cut.select("h", F.col("node").alias("b"), F.col("c").alias("c_b"), F.col("n").alias("n_b"))
            rest = own.join(other, "h").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & fits(F.col("n_a"), F.col("n_b")))
            pairs = pairs.unionByName(rest.select("a", "b", "n_a", "n_b"))
        pairs = materialize(possible(pairs), "pairs")
        more = [product(pairs, docs)] if pairs.limit(1).count() else []
        columns = mixed.where(F.col("k") > LONG_COLUMN)
        large = None
        if columns.limit(1).count():
            rows = materialize(clusters(within(long, columns), named), "clustered")
            minor = rows.where("c <> top").groupBy("cluster").count()
            large = materialize(minor.where(F.col("count") > (DENSE if depth < DEPTH else 1 << 62)).select("cluster"), "large")
            more.append(squared(rows.join(large, "cluster", "left_anti"), docs))
        if more:
            more = materialize(more[0] if len(more) == 1 else more[0].unionByName(more[1]), "links")
            if more.limit(1).count():
                edges = materialize(edges.unionByName(more), "links")
                joined = components(edges, materialize).select(F.col("node").alias("l_node"), F.col("component").alias("l_c"))
        if large is None or not large.limit(1).count():
            break
        nodes = rows.join(large, "cluster", "left_semi").select(F.col("node").alias("doc_id")).distinct()
        groups = having(outer(within(named, columns)).groupBy(F.col("node").alias("doc_id")).agg(F.collect_set("h").alias("groups")), materialize(nodes, "nodes"))
        inside = materialize(texts_of(docs, groups.select("doc_id")).join(groups, "doc_id"), "inside")
        post = columns_of(signatures(inside, sketch(inside.select("text", "groups"), INNER_SHARE)))
    named = classes.join(joined, classes.node == F.col("l_node"), "left").select("f1", "f2", "n_shingles", F.coalesce("l_c", classes.node).alias("component_id"))
    return (
        sets.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id (of its repeated rows, one whole row); rows without doc_id stay."""
    found = similar(docs).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.min("component_id").alias("own"), F.count("*").alias("rows")).where("own <> doc_id or rows > 1")
    ids = materialize(ids.select("doc_id", (F.col("own") == F.col("doc_id")).alias("stays")), "verdicts")
    few = ids.count() <= BROADCAST_IDS
    id_, stays = fresh(docs, "id"), fresh(docs, "stays")
    ids = ids.select(F.col("doc_id").alias(id_), F.col("stays").alias(stays))
    of = lambda ids, how: docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids[id_], how)
    return of(ids, "left_anti").unionByName(of(ids.where(stays), "left_semi").dropDuplicates(["doc_id"]))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
sized AS (SELECT doc_id, len(sh)::BIGINT AS n, md5(array_to_string(list_sort(sh), chr(10))) AS f FROM s),
cls AS (SELECT f, n, min(doc_id) AS node FROM sized WHERE n > 0 GROUP BY f, n),
e AS (SELECT DISTINCT c.node, c.n, u.x FROM cls c JOIN s ON s.doc_id = c.node, unnest(s.sh) AS u(x)),
p AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, c) AS (SELECT node, node FROM cls UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.node),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT sized.doc_id, sized.n AS n_shingles, coalesce(m.c, sized.doc_id)::BIGINT AS component_id
FROM sized LEFT JOIN cls ON sized.f = cls.f AND sized.n = cls.n LEFT JOIN m ON m.node = cls.node
"""
