"""Periodic runs of words: stretches that repeat a passage of q words four times and more.

A run is a stretch of words with smallest period q (words q apart are equal) and length max(LEAST, TIMES * q) or more
that no neighbouring word extends. Words become integers, text by text. For each power of two B:
  1. Distances q belong to the scale B where every run of period q holds an aligned block of B words with its repeat q
     words on: (2 B - 1) / 3 <= q < (4 B - 1) / 3. Blocks of which a word does not recur within the scale's longest
     distance can't be in such a run and are left out.
  2. Neighbouring blocks, CHUNK at a time, are the integer-sequence keys of an Aho-Corasick automaton, which is run over the
     text from the first block to the longest distance behind the last one. An occurrence at a distance of the scale is a seed.
  3. Blocks inside a shorter period's run are not searched for: a longer run through such a block holds the end of that
     run, and the end of one like it a distance of the scale on, which is the seed; there is none where the run
     reaches beyond all that a distance of the scale spans.
  4. A seed is extended exactly in both directions as far as words q apart are equal. Seeds inside an extension of
     the same distance, or in a run whose period divides the distance, are passed over. Stretches that are long
     enough and have no smaller period are runs.
Each text is looked at whole in one narrow map, in time n log n but for texts made against it; no shuffle.

Cases: null and empty texts and texts of white space have no runs and collapse to an empty text; repeated rows are
looked at each; a null key stays null; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import count

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_beside, schema

LEAST, TIMES = 6, 4
#: Blocks of an automaton: its root's children are searched one by one.
CHUNK = 64
RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers: the place of the first of them."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def recurrences(ids: np.ndarray) -> np.ndarray:
    """Words to the next equal one; their number where there is none."""
    at = np.argsort(ids, kind="stable")
    found = np.full(len(ids), len(ids))
    same = ids[at[1:]] == ids[at[:-1]]
    found[at[:-1][same]] = (at[1:] - at[:-1])[same]
    return found


def chunks(at: np.ndarray, reach: int):
    """Blocks that are searched together: CHUNK at most, none further than reach from the one before."""
    edges = np.flatnonzero(np.diff(at) > reach) + 1
    for part in np.split(at, edges):
        for k in range(0, len(part), CHUNK):
            yield part[k : k + CHUNK].tolist()


def seeds(ids: np.ndarray, at: np.ndarray, size: int, low: int, high: int) -> list[tuple[int, int]]:
    """(distance, start) of the blocks of `size` words at these places that recur between low and high words on."""
    found = []
    for part in chunks(at, size + high):
        first = part[0]
        text = tuple(ids[first : part[-1] + size + high].tolist())
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        key_at = {}
        for p in part:
            key = text[p - first : p - first + size]
            key_at[p] = automaton.get(key, p)
            automaton.add_word(key, key_at[p])
        automaton.make_automaton()
        for end, key in automaton.iter(text):
            start = first + end - size + 1
            p = -(-(start - high) // size) * size  # the scale's distances span less than a block: one aligned place at most
            if start - p >= low and key_at.get(p) == key:
                found.append((start - p, p))
    return found


def inner_seeds(at: np.ndarray, ends: np.ndarray, periods: np.ndarray, runs: list, size: int, low: int, high: int) -> list[tuple[int, int]]:
    """(distance, start) of blocks inside runs with these ends and periods: from the run's end to that of a run of the same period."""
    like: dict[int, list[int]] = {}
    for _, e, q in sorted(runs, key=lambda r: r[1]):
        like.setdefault(q, []).append(e)
    found = []
    for p, e, q in zip(at.tolist(), ends.tolist(), periods.tolist(), strict=True):
        for other in like[q][bisect_left(like[q], e + low) : bisect_right(like[q], e + high)]:
            found.append((other - e, p))
    return found


def equal_until(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    done, step = 0, 64
    while done < len(a):
        differ = a[done : done + step] != b[done : done + step]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 2 * step
    return len(a)


def primitive(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the run from start on."""
    rest, f = q, 2
    while rest > 1:
        f = f if f * f <= rest else rest
        if rest % f:
            f += 1
            continue
        d = q // f
        if (ids[start : start + q] == ids[start + d : start + d + q]).all():
            return False
        while not rest % f:
            rest //= f
    return True


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period."""
    n, runs = len(ids), []
    if n < LEAST:
        return runs
    longest = recurrences(ids)  # of the words of each block
    far, owner = np.zeros(n, np.int64), np.zeros(n, np.int64)  # the furthest end of a run over each word, and its period
    size = 1
    while True:
        size *= 2
        low, high = -(-(2 * size - 1) // 3), -(-(4 * size - 1) // 3) - 1
        if low * TIMES > n:
            return sorted((s, e - s, q) for s, e, q in runs)
        even = len(longest) // 2 * 2
        longest = np.maximum(longest[0:even:2], longest[1:even:2])
        at = np.flatnonzero(longest <= high) * size
        ends, periods = far[at], owner[at]
        inner = (ends >= at + size) & (TIMES * periods <= size)
        edge = inner & (ends < at + high + periods)
        found = seeds(ids, at[~inner], size, low, high) + inner_seeds(at[edge], ends[edge], periods[edge], [r for r in runs if r[1] - r[0] >= size], size, low, high)
        done = (0, 0)  # distance and end of the last extension
        for q, p in sorted(found):
            if done[0] == q and p < done[1] or far[p] >= p + q and owner[p] < q and q % owner[p] == 0:
                continue
            end = p + equal_until(ids[p : n - q], ids[p + q :])
            if end < p + size:  # the ends are like each other, the block is not
                continue
            start = p - equal_until(ids[:p][::-1], ids[q : p + q][::-1])
            done = (q, end)
            if end + q - start >= max(LEAST, TIMES * q) and primitive(ids, start, q):
                runs.append((start, end + q, q))
                over = np.flatnonzero(far[start : end + q] < end + q) + start
                far[over], owner[over] = end + q, q


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those after the first q of any run, with a blank between."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def periodic(df: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """key, runs (start, length, period; by start, then period), collapsed of every row; change(key, words) may alter the words first."""

    def make():
        def f(c):
            out: tuple[list, list] = ([], [])
            for k, t in zip(*c, strict=True):
                words = (t or b"").split()  # the six white-space characters
                words = change(k, words) if change else words
                runs = find_runs(numbers(words))
                out[0].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                out[1].append(collapsed(words, runs))
            return out

        return f

    rows = df.select(F.col(key).alias("key"), F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    return map_beside(rows, make, schema(RUNS)).select(F.col("key").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def strongest(runs):
    """The run of greatest length / period, then smallest start, then period; null without runs. Quotients of numbers below 2^26 are equal as doubles only if they are."""
    best = F.array_max(F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("n"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["n"].alias("length"), (-best["q"]).alias("period")))


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: a tenth of the documents repeat a part of themselves to their end; rows without doc_id stay as they are."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[: a + p] + words[a : a + p] * ((n - a) // p))[:n]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic(documents(spark, sf_dir), change=planted).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
