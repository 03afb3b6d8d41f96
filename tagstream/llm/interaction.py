"""Filter interaction audit: what each quality filter removes after any others, over all orders of the filters.

Orders form a trie, whose nodes are prefixes. The survivors of a prefix don't depend on its order, so unordered prefixes are
walked depth first with memoisation: each is one persisted DataFrame, made from the parent's by one more filter; its
row counts, and what each remaining filter removes from it, are counted in one aggregation, which is written to
the shared folder. At most one state a level is persisted at a time, as narrow rows (part, failures, label marks).
A row for each part, order and step then comes from the written counts by joins with the fixed list of orders.

Failures are columns of a narrow table that is written once, so that lost executors repeat no text work. Copies are
known by the SHA-256 of their texts; the smallest doc_id of each text that has several rows is joined back, the
texts with most rows by broadcast (MOST of them at most), the rest by their hash.

Cases: null texts are empty; an empty text fails the length filter alone (its copies fail as copies, too); null doc_ids are no
copy's original and never fail as copies; rows that repeat doc_id and text fail alike, so that the first stays and repeats
stay with it; null parts are the empty string; several labels of a doc_id count as one that has all their marks, null labels as none;
no rows give no rows. Columns besides doc_id, text and the part are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, folder, joined_first, materialize, passing, text_or_empty

SPACE, SYMBOLS = "[\\x20\\x09-\\x0D]", "[#$%&*|]"
LOST = {"good_lost": "good", "toxic_lost": "toxic"}


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter on its own."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100, "B": 100 * distinct.cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, A to E (whether the document fails), good, toxic; a row a document."""
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("copy"), *(c.alias(k) for k, c in text_filters(F.col("text")).items()))
    rows = materialize(rows, "failures")
    copies = rows.groupBy("copy").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null")
    rows = joined_first(rows, materialize(copies, "copies"), "copy")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(marks, rows["doc_id"] == marks["of"], "left")
    fails_e = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E")
    return rows.select("part", "A", "B", "C", "D", fails_e, *(F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")))


def counted(survivors: DataFrame, filters: str) -> DataFrame:
    """A row a part: its documents, and of each filter what it removes, and what it alone removes. The same plan for each state."""
    alone = lambda f: F.col(f) & ~F.greatest(F.lit(False), F.lit(False), *(F.col(g) for g in filters if g != f))
    sums = lambda f: [F.count_if(F.col(f)).alias(f"removed_{f}"), *(F.count_if(F.col(f) & F.col(m)).alias(f"{name}_{f}") for name, m in LOST.items()), F.count_if(alone(f)).alias(f"alone_{f}")]
    return survivors.groupBy("part").agg(F.count("*").alias("n"), *(s for f in filters for s in sums(f)))


def walk(survivors: DataFrame, filters: str, passed: frozenset[str], seen: set[frozenset[str]]) -> Iterator[tuple[frozenset[str], DataFrame]]:
    """(state, its counts) of each unordered prefix below this one, once; the survivors stay persisted while the walk is below them."""
    seen.add(passed)
    kept = survivors.persist(StorageLevel.MEMORY_AND_DISK)
    yield passed, counted(kept, filters)
    for f in filters:
        if f not in passed and passed | {f} not in seen:
            yield from walk(kept.where(~F.col(f)), filters, passed | {f}, seen)
    kept.unpersist()


def mask(passed, filters: str) -> int:
    return sum(1 << filters.index(f) for f in passed)


def steps(filters: str) -> list[tuple[str, int, str, int, int]]:
    """filter_order, step, its filter, and the states before and after it, of all orders."""
    return [("".join(o), k + 1, f, mask(o[:k], filters), mask(o[: k + 1], filters)) for o in permutations(filters) for k, f in enumerate(o)]


def edges(rows: DataFrame, filters: str) -> DataFrame:
    """part, state, filter, n (documents of the state), removed, good_lost, toxic_lost, alone: a row for each part, state and filter (nothing to remove where it is passed)."""
    path = f"{folder(rows.sparkSession)}/edges-{uuid.uuid4().hex}"
    names = ["removed", *LOST, "alone"]
    each = F.array(*(F.struct(F.lit(f).alias("filter"), *(F.col(f"{name}_{f}").alias(name) for name in names)) for f in filters))
    for passed, counts in walk(rows, filters, frozenset(), set()):
        counts.select("part", F.lit(mask(passed, filters)).alias("state"), "n", F.inline(each)).write.mode("append").parquet(path)
    passing(rows.sparkSession, path)
    return rows.sparkSession.read.schema("part string, state int, n long, filter string, removed long, good_lost long, toxic_lost long, alone long").parquet(path)


def audit_filters(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """From failures(): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of each part, order and step."""
    found = edges(rows, filters)
    start = found.where("state = 0").select("part", F.col("filter").alias("f"), F.col("removed").alias("fails"), F.col("alone").alias("unique_fails"))
    orders = F.broadcast(rows.sparkSession.createDataFrame(steps(filters), "filter_order string, step int, filter string, before int, after int"))  # a fixed list
    all_steps = start.join(orders, F.col("f") == F.col("filter")).drop("f")
    taken = found.select("part", "filter", F.col("state").alias("before"), "removed", *LOST)
    states = found.groupBy("part", F.col("state").alias("after")).agg(F.max("n").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = all_steps.join(taken, ["part", "filter", "before"], "left").join(states, ["part", "after"], "left")
    rows = rows.select("part", "filter_order", "step", "filter", zero(F.col("kept")).alias("kept"), zero(F.col("removed")).alias("removed"), (F.col("fails") - zero(F.col("removed"))).alias("redundant"), "unique_fails", *(zero(F.col(c)).alias(c) for c in LOST))
    sums = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(sums, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *LOST, "shapley")


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(failures(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < w.doc_id, false)::INT AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM f GROUP BY part, bits),
p(filter_order, step, letter, before) AS (SELECT o, k, substr(o, k, 1), list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))) FROM (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(x), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(x)
  WHERE length(regexp_replace('ABCDE', '[' || a.x || b.x || c.x || d.x || e.x || ']', '', 'g')) = 0) o, generate_series(1, 5) s(k)),
q AS (SELECT filter_order, step::INT AS step, letter, coalesce(before, 0)::INT AS before, (1 << (ascii(letter) - 65))::INT AS own FROM p),
r AS (SELECT c.part, filter_order, step, letter, sum(n) FILTER (WHERE bits & (before | own) = 0) AS kept, sum(n) FILTER (WHERE bits & before = 0 AND bits & own > 0) AS removed,
  sum(n) FILTER (WHERE bits & before > 0 AND bits & own > 0) AS redundant, sum(n) FILTER (WHERE bits = own) AS unique_fails,
  sum(g) FILTER (WHERE bits & before = 0 AND bits & own > 0) AS good_lost, sum(t) FILTER (WHERE bits & before = 0 AND bits & own > 0) AS toxic_lost FROM c, q GROUP BY c.part, filter_order, step, letter)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
