"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document belongs to a block of its source by a hash of its id; there is a block for each BLOCK_WORDS words of the
input (LEAST_BLOCKS at least), and an output shard for each SHARD_WORDS words. A source's target is reached
by whole passes over its blocks, by further blocks in a permuted order as long as they fit, and by single documents of the blocks
around the place where these end, CAP times at most each, until none of them fits into what is left.
The source's exact number of draws (of blocks, then of single documents) is its quota: a splitting tree halves the shards again
and again and deals the quotas to the halves by multivariate hypergeometric draws, each
node seeded by its place. A shard then takes the next disjoint run of every source's permuted
draws, and its rows are ordered by a hash. Each task walks the tree for the draws of its own rows.

Blocks are ranked by running sums over ranges of the hashes that permute them, and inside each range, so that no task holds a source's blocks.
The driver holds a row a source; blocks are a table.

Cases: a null source is a source of its own, after all others; null and empty texts have size 0;
the rows of a null doc_id are one document; repeated rows are taken together; a source
without words has target 0; an empty table gives no rows; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, map_rows, materialize, schema, whole

BLOCK_WORDS, LEAST_BLOCKS, SHARD_WORDS, LEAST_SHARDS = 1 << 20, 1024, 1 << 25, 64
SEED, CAP = 17, 3
#: Ranges of a source's permuted blocks; words on either side of the last further block whose documents may fill what is left.
RANGES, NEAR_WORDS = 1024, 1 << 18
BROADCAST_ROWS = 200_000


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> dict[str | None, float]:
    """Shares of the sum of sizes by weight; none above cap times its size, the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, open_ = float(sum(sizes.values())), {}, names
    while open_:
        left, by = total - sum(out.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / by > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / by for s in open_}
        out |= {s: float(cap * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in out]
    return out


def dealt(source: np.ndarray, draw: np.ndarray, quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """The shard of each draw (numbered from 0 in its source): every shard gets a run of each source's draws, and the runs add up to the quotas."""
    out = np.zeros(len(draw), np.int64)

    def node(lo: int, hi: int, have: np.ndarray, rows: np.ndarray, draw: np.ndarray) -> None:
        if hi - lo == 1 or not len(rows):
            out[rows] = lo
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, round(int(have.sum()) * (mid - lo) / (hi - lo)), method="marginals")
        own = left[source[rows]]
        on = draw < own
        node(lo, mid, left, rows[on], draw[on])
        node(mid, hi, have - left, rows[~on], (draw - own)[~on])

    node(0, shards, quotas.astype(np.int64), np.arange(len(draw)), draw)
    return out


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size_, hash_."""
    return docs.select("doc_id", "source", size_of().alias("size_"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("hash_"))


def in_block(blocks: int):
    return F.pmod(F.col("hash_"), F.lit(blocks)).cast("long")


def power(words: int, each: int, least: int) -> int:
    return max(least, 1 << max(0, (words // each) - 1).bit_length())


def joined(rows: DataFrame, other: DataFrame, on, n: int, how: str = "inner") -> DataFrame:
    """other is broadcast if it has few enough rows."""
    return rows.join(F.broadcast(other) if n <= BROADCAST_ROWS else other, on, how)


def ranked(per_block: DataFrame, have: DataFrame, sources: int, seed: int) -> DataFrame:
    """A row a block in the permuted order of its source: at_ (its place), up_to_ (words up to its end), more_ (1 if it is taken once more)."""
    rows = per_block.withColumn("order_", F.xxhash64(F.lit(seed + 1), "block_"))
    rows = rows.withColumn("range_", F.pmod(F.shiftrightunsigned("order_", 40), F.lit(RANGES)))
    before = Window.partitionBy("source").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a source
    parts = rows.groupBy("source", "range_").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = materialize(parts.select(F.col("source").alias("p_s"), F.col("range_").alias("p_r"), zero("w").alias("words_before"), zero("n").alias("blocks_before")), "ranges")
    rows = joined(rows, parts, F.col("source").eqNullSafe(F.col("p_s")) & (F.col("range_") == F.col("p_r")), sources * RANGES)
    upto = Window.partitionBy("source", "range_").orderBy("order_", "block_").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("up_to_", F.col("words_before") + F.sum("words").over(upto)).withColumn("at_", F.col("blocks_before") + F.count("*").over(upto) - 1)
    rows = joined(rows, have, F.col("source").eqNullSafe(F.col("s_")), sources).withColumn("more_", (F.col("up_to_") <= F.col("gap_")).cast("int"))
    return materialize(rows.select("source", "block_", "words", "up_to_", "at_", "more_", "idx_", "full_", "gap_", "n_"), "permuted")


def greedy(words: np.ndarray, room: np.ndarray, gap: float) -> np.ndarray:
    """Places of what is taken, in order: each that fits into what is left, up to `room` times in as many turns."""
    found, times = [], np.zeros(len(words), np.int64)
    for _ in range(CAP):
        at = np.flatnonzero((times < room) & (words <= gap))
        while len(at):
            sums = np.cumsum(words[at])
            k = int(np.searchsorted(sums, gap, "right"))
            if k:
                found.append(at[:k])
                times[at[:k]] += 1
                gap -= int(sums[k - 1])
            rest = at[k + 1 :]
            at = rest[words[rest] <= gap]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def singled(narrow: DataFrame, ordered: DataFrame, have: DataFrame, left: DataFrame, sources: int, seed: int) -> DataFrame:
    """idx_, doc_id, turn_ (number of the draw among them): single documents that fill what is left of each source, those of blocks of which no more is taken first.
    A source's candidates are at most twice NEAR_WORDS words and the blocks at the borders."""
    at_border = (F.col("up_to_") - F.col("words") <= F.col("gap_") + NEAR_WORDS) & (F.col("up_to_") >= F.col("gap_") - NEAR_WORDS)
    near = ordered.where(at_border & (F.col("full_") + F.col("more_") < CAP))
    near = materialize(near.select(F.col("source").alias("b_s"), F.col("block_").alias("b_b"), "idx_", "more_", (CAP - F.col("full_") - F.col("more_")).alias("room_")), "near")
    pool = joined(narrow.where("size_ > 0"), near, F.col("source").eqNullSafe(F.col("b_s")) & (F.col("block_") == F.col("b_b")), near.count())
    pool = pool.groupBy("idx_", "doc_id").agg(F.sum("size_").alias("words"), F.first("room_").alias("room_"), F.first("more_").alias("more_"))
    pool = joined(pool, left, "idx_", sources).where("words <= left_").withColumn("order_", F.xxhash64(F.lit(seed + 2), "doc_id"))

    def fill(table: pa.Table) -> pa.Table:
        t = table.sort_by([("more_", "ascending"), ("order_", "ascending"), ("doc_id", "ascending")])
        words, room, gap = t["words"].to_numpy(), t["room_"].to_numpy(), t["left_"][0].as_py()
        orders = (np.arange(len(words)), np.argsort(-words, kind="stable"))
        at = min((o[greedy(words[o], room[o], gap)] for o in orders), key=lambda at: -words[at].sum())  # the longest first where that comes nearer
        return pa.table({"idx_": t["idx_"].take(at), "doc_id": t["doc_id"].take(at), "turn_": pa.array(np.arange(len(at)))})

    return materialize(pool.groupBy("idx_").applyInArrow(fill, "idx_ int, doc_id long, turn_ long"), "picks")


def shards_of(draws: DataFrame, quotas: np.ndarray, shards: int, seed: int, kept: str) -> DataFrame:
    """From idx_, first_ (number of the draw), times_, step_ and the kept columns: these and draws_, the shards of the draws first_, first_ + step_, ..."""
    shared = draws.sparkSession.sparkContext.broadcast(quotas)

    def make():
        def f(c):
            source, first, times, step = (np.array(x, np.int64) for x in c[:4])
            of = np.repeat(np.arange(len(times)), times)
            turn = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            found = dealt(source[of], first[of] + turn * step[of], shared.value, shards, seed)
            cut = np.cumsum(times)[:-1]
            return [*c[4:], [x.tolist() for x in np.split(found, cut)]] if len(times) else [*c[4:], []]

        return f

    names = [x.split()[0] for x in kept.split(", ")]
    return map_rows(draws.select("idx_", "first_", "times_", "step_", *names), make, schema(f"{kept}, draws_ array<int>"))


def plan(narrow: DataFrame, blocks: int, shards: int, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """From doc_id, source, size_, block_: a row a source, and the shards of each block's and each single document's draws; the number of sources."""
    spark = narrow.sparkSession
    per_block = materialize(narrow.groupBy("source", "block_").agg(F.sum("size_").alias("words")), "blocks")
    rows = {r.source: r for r in per_block.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect()}
    sizes = {s: r.words for s, r in rows.items()}
    goal, names = targets(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    full = {s: min(CAP, int(goal[s] // sizes[s])) if sizes[s] else 0 for s in names}
    gap = {s: goal[s] - full[s] * sizes[s] for s in names}
    have = spark.createDataFrame([(k, s, sizes[s], float(goal[s]), full[s], float(gap[s]), rows[s].n) for k, s in enumerate(names)], "idx_ int, s_ string, source_size long, target double, full_ int, gap_ double, n_ long")
    ordered = ranked(per_block, have, len(names), seed)
    more = {r.idx_: (r.n, r.words) for r in ordered.where("more_ = 1").groupBy("idx_").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    left = spark.createDataFrame([(k, float(gap[s] - more.get(k, (0, 0))[1])) for k, s in enumerate(names)], "idx_ int, left_ double")
    picks = singled(narrow, ordered, have, left, len(names), seed)
    picked = {r.idx_: r.n for r in picks.groupBy("idx_").agg(F.count("*").alias("n")).collect()}
    passes = [full[s] * rows[s].n + more.get(k, (0, 0))[0] for k, s in enumerate(names)]
    quotas = np.array([n + picked.get(k, 0) for k, n in enumerate(passes)], np.int64)
    draws = ordered.select("idx_", F.col("at_").alias("first_"), (F.col("full_") + F.col("more_")).alias("times_"), F.col("n_").alias("step_"), F.col("source").alias("b_s"), F.col("block_").alias("b_b"))
    by_block = shards_of(draws, quotas, shards, seed, "b_s string, b_b long")
    after = spark.createDataFrame([(k, s, n) for (k, s), n in zip(enumerate(names), passes, strict=True)], "idx_ int, p_s string, passes_ long")
    singles = joined(picks, after, "idx_", len(names)).select("idx_", (F.col("passes_") + F.col("turn_")).alias("first_"), F.lit(1).alias("times_"), F.lit(1).alias("step_"), "p_s", F.col("doc_id").alias("p_d"))
    singles = shards_of(singles, quotas, shards, seed, "p_s string, p_d long").groupBy("p_s", "p_d").agg(F.sort_array(F.flatten(F.collect_list("draws_"))).alias("own_"))  # CAP at most each
    return have.select("s_", "source_size", "target"), materialize(by_block, "draws"), materialize(singles, "singles"), len(names)


def drawn(rows: DataFrame, by_source: DataFrame, by_block: DataFrame, singles: DataFrame, sources: int) -> DataFrame:
    """rows (with doc_id, source, block_) and source_size, target, shards_ (the shard of each copy)."""
    rows = joined(rows, by_source, F.col("source").eqNullSafe(F.col("s_")), sources)
    rows = joined(rows, by_block, F.col("source").eqNullSafe(F.col("b_s")) & (F.col("block_") == F.col("b_b")), by_block.count())
    rows = joined(rows, singles, F.col("source").eqNullSafe(F.col("p_s")) & F.col("doc_id").eqNullSafe(F.col("p_d")), singles.count(), "left")
    return rows.withColumn("shards_", F.concat("draws_", F.coalesce("own_", F.array().cast("array<int>")))).drop("s_", "b_s", "b_b", "p_s", "p_d", "own_", "draws_")


def mixed(docs: DataFrame, shards: int | None = None, seed: int = SEED):
    """doc_id, source, size_, block_ of docs; the plan; blocks."""
    sized = materialize(measured(docs, seed), "sizes")
    words = sized.agg(F.sum("size_")).first()[0] or 0
    blocks, shards = power(words, BLOCK_WORDS, LEAST_BLOCKS), shards or power(words, SHARD_WORDS, LEAST_SHARDS)
    narrow = sized.select("doc_id", "source", "size_", in_block(blocks).alias("block_"))
    return narrow, plan(narrow, blocks, shards, seed), blocks


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow, made, _ = mixed(documents(spark, sf_dir))
    return drawn(narrow, *made).select(
        "doc_id", F.col("size_").alias("size"), "source_size", "target", (F.col("size_") * F.size("shards_")).alias("taken"), "source", F.col("shards_").alias("shards"),
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, shards: int | None = None) -> DataFrame:
    """The mix itself: a row for each copy that is taken, by shard and shuffled inside it; the columns of docs."""
    _, made, blocks = mixed(docs, shards)
    rows = docs.select(whole(docs).alias("row_"), "doc_id", "source", F.xxhash64(F.lit(SEED), F.col("doc_id")).alias("hash_")).withColumn("block_", in_block(blocks))
    copies = drawn(rows, *made).select("row_", "doc_id", F.posexplode("shards_").alias("copy_", "shard_"))
    return copies.repartition("shard_", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("shard_", F.xxhash64(F.lit(SEED + 3), "doc_id", "copy_")).select("row_.*")
