"""Line dedup with a log-template tree.

A line's tokens are masked (tokens with digits are variable) and routed through a tree of fixed depth: token count, then the two
leading tokens; branches with a variable leading token hold lines that agree in half of their other places instead. In a leaf, lines
belong to one template when they agree in half of their places:
  1. Equal masked lines are one, with its documents counted. Branches of more than one such line are looked at (Spark counts them); their lines' tokens are read.
  2. The places after the leading two are dealt to four quarters in turn. Lines of a leaf that agree in a quarter are candidates: three
     changing fields leave a quarter alone, wherever they are. They are compared token by token: with the first of them, and those
     that are unlike it with all. More than GROUP candidates are cut into slices by hash, which all get the line of the smallest document;
     lines that are then outside of the candidates' largest template are compared, in blocks, with the other templates' lines of every slice.
  3. Alike lines are joined up to templates by the shared component code; where their tokens differ is learnt: templates()
     gives the tokens that all of them share and a mark for each that varies.
Lines of under LONG tokens must agree everywhere. Consecutive lines (those without words aside) that reach LONG_RUN tokens only
together are a template of that length, equal token for token.

A template recurs when it stands in least_docs() documents or more (fewer for longer lines); its lines stay in the document of the
smallest doc_id and are dropped elsewhere. A document that keeps under a quarter of its words is marked
as a copy; the pipeline drops it only if no word of it is left.

Lines to be read and lines to be dropped are broadcast, as sorted arrays, if there are MAX_KEYS at most, otherwise they are joined.

Cases: null text stays null; empty texts and lines without words stay as they are; repeated lines
inside one document alone are no recurrence; repeated rows of a doc_id are one document; null
ids count as documents of their own, after all others; texts of any length are parsed whole, in memory in proportion to
them; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import components
from .common import documents, joined_first, map_beside, map_rows, materialize, mix, powers, schema, whole, word_bounds
from .simhash import by_cell

LEADING, LONG, LONG_RUN, QUARTERS = 2, 8, 20, 4
#: Lines that are compared with each other, and tokens of a comparison at once.
GROUP, CELLS = 4096, 1 << 22
MAX_KEYS = 2_000_000
KEEP_NUM, KEEP_DEN = 1, 4
#: Characters of the texts that are parsed at once.
PART = 1 << 18
_U = np.uint64
_VARIABLE = _U(0x5BD1E995)

def least_docs(tokens):
    """Documents that make a template recur: chance repeats of short lines are no boilerplate."""
    return np.where(tokens >= LONG_RUN, 2, np.where(tokens >= LONG, 3, 10))


def prefixed(values: np.ndarray, state: dict) -> np.ndarray:
    """Running sums that hashes of spans of values are taken from."""
    up, _ = powers(state, len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=total[1:])
    return total


def span(total: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int, state: dict) -> np.ndarray:
    """Hashes of values[a:b] of each span."""
    _, down = powers(state, len(total))
    return mix(((total[b] - total[a]) * down[a]) ^ mix((b - a).astype(_U), salt), salt)


class Keys:
    """The templates that lines and runs of lines of some texts may belong to: arrays of key, tokens, first and last line
    and doc (place of the text); lines are counted over all texts, base is the first of each."""

    def __init__(self, texts: list[str], state: dict):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw, start, end = word_bounds(b"\n".join(coded))
        per = np.array([c.count(b"\n") + 1 for c in coded], np.int64)
        self.base = np.concatenate([[0], np.cumsum(per)])
        doc_of = np.repeat(np.arange(len(texts)), per)
        if not len(start):
            self.key, self.masked, self.long = np.empty(0, _U), np.empty(0, _U), slice(0, 0)
            self.start = self.end = self.place = np.empty(0, np.int64)
            self.tokens = self.first = self.last = self.doc = np.empty(0, np.int64)
            return
        exact = span(prefixed(raw, state), start, end, 7, state)
        digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
        masked = np.where(digits[end] > digits[start], _VARIABLE, exact)
        line = np.searchsorted(np.flatnonzero(raw == 10), start)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        upto = np.concatenate([first[1:], [len(line)]])
        n, number = upto - first, line[first]
        total = prefixed(masked, state)
        out: list[tuple] = []
        short = n < LONG
        own = span(total, first[short], upto[short], 1, state)
        out.append((own, n[short], number[short], number[short]))
        a, z, at = first[~short], upto[~short], number[~short]
        own = span(total, a, z, 5, state)
        out.append((own, n[~short], at, at))
        self.long, self.start, self.end, self.masked = slice(int(short.sum()), len(n)), a, z, masked
        self.place = np.arange(len(masked)) - np.repeat(first, n)
        # the shortest runs of LONG_RUN tokens from each line on and up to each line; any longer run is made of these
        ends, doc = np.concatenate([[0], np.cumsum(n)]), doc_of[number]
        left = np.arange(len(n))
        stop = np.searchsorted(doc, doc, "right")
        right = np.searchsorted(ends, ends[:-1] + LONG_RUN)
        back = np.searchsorted(ends, ends[1:] - LONG_RUN, "right") - 1
        fore, aft = right <= stop, back >= np.searchsorted(doc, doc, "left")
        pairs = np.unique(np.concatenate([left[fore] * (len(n) + 1) + right[fore], back[aft] * (len(n) + 1) + left[aft] + 1]))
        x, y = pairs // (len(n) + 1), pairs % (len(n) + 1)
        x, y = x[y - x > 1], y[y - x > 1]
        own = span(prefixed(exact, state), ends[x], ends[y], 31, state)
        out.append((own, ends[y] - ends[x], number[x], number[y - 1]))
        self.key, self.tokens, self.first, self.last = (np.concatenate(c) for c in zip(*out, strict=True))
        self.doc = doc_of[self.first]


    def quarters(self) -> np.ndarray:
        """(QUARTERS, long lines): hashes of the tokens of each quarter of the places after the leading ones."""
        own, where = mix(self.masked ^ (self.place.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15), 41), (self.place - LEADING) % QUARTERS
        rest, found = self.place >= LEADING, []
        for q in range(QUARTERS):
            total = np.zeros(len(own) + 1, _U)
            np.cumsum(np.where(rest & (where == q), own, _U(0)), out=total[1:])
            found.append(total[self.end] - total[self.start])
        return np.array(found).reshape(QUARTERS, -1)

    def branches(self, quarters: np.ndarray) -> np.ndarray:
        """(1 + 4, long lines): the leaf, and for each leading token that may vary the branches of lines that agree in either half of the other places."""
        size, lead = (self.end - self.start).astype(_U), [self.masked[self.start + k] for k in range(LEADING)]
        found = [mix(lead[0] ^ mix(lead[1] ^ size, 2), 3)]
        for k in range(LEADING):
            node = mix(lead[1 - k] ^ mix(size, 51 + k), 53)
            found += [mix(node ^ (quarters[h] + quarters[h + 2]), 55 + h) for h in range(2)]
        return np.array(found)


def parted(texts: list[str | None]):
    """(place of the first, texts) of some texts at a time, so that small ones share a call and long ones take no more memory than they need."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > PART:
            yield start, [t or "" for t in texts[start:k]]
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]


def once(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first of each (doc, value)."""
    order = np.lexsort((value, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (value[order[1:]] != value[order[:-1]])
    return order[new]


def as_longs(x: np.ndarray) -> list:
    """Rows of unsigned numbers as lists of signed ones."""
    return np.ascontiguousarray(x).view(np.int64).tolist()


def postings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """h, tokens, doc_id, branches (of long lines): each key of a document once."""

    def make():
        state: dict = {}

        def f(c):
            h, n, ids, branches = [], [], [], []
            for start, part in parted(c[1]):
                k = Keys(part, state)
                use = once(k.doc, k.key)
                of = np.full(len(k.key), -1)
                of[k.long] = np.arange(len(k.start))
                rows = k.branches(k.quarters()).T if len(k.start) else np.empty((0, 5), _U)
                h.append(k.key[use])
                n.append(k.tokens[use])
                ids += [c[0][start + d] for d in k.doc[use].tolist()]
                own = as_longs(rows)
                branches += [own[i] if i >= 0 else None for i in of[use].tolist()]
            return [np.concatenate(h).view(np.int64), np.concatenate(n), ids, branches] if h else [[], [], [], []]

        return f

    return map_rows(df.select(F.col(key).cast("long").alias("doc_id"), text), make, schema("h long, tokens int, doc_id long, branches array<long>"))


def marked(df: DataFrame, wanted: DataFrame, make, out: str, max_keys: int) -> DataFrame:
    """map_rows of make(sorted array of wanted.h, or None for all) over doc_id, text. Where there are more than max_keys, rows of all are made, and those of others go by a join."""
    if wanted.count() > max_keys:
        return map_rows(df, lambda: make(None), schema(out)).join(wanted.select("h"), "h", "left_semi")
    shared = df.sparkSession.sparkContext.broadcast(np.sort(wanted.select("h").toArrow()["h"].to_numpy()))
    return map_rows(df, lambda: make(shared.value), schema(out))


def among(own: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    if wanted is None:
        return np.ones(len(own), bool)
    if not len(wanted):
        return np.zeros(len(own), bool)
    return wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own


def token_table(df: DataFrame, wanted: DataFrame, max_keys: int) -> DataFrame:
    """h, codes (four bytes a token), quarters of the wanted long lines, each once."""

    def make(only):
        state: dict = {}

        def f(c):
            h, codes, quarters = [], [], []
            for _, part in parted(c[1]):
                k = Keys(part, state)
                if not len(k.start):
                    continue
                own = k.key[k.long].view(np.int64)
                use = np.flatnonzero(among(own, only))
                if not len(use):
                    continue
                use = use[np.unique(own[use], return_index=True)[1]]
                low, q = (k.masked >> _U(32)).astype(np.uint32), as_longs(k.quarters().T[use])
                h.append(own[use])
                codes += [low[a:z].tobytes() for a, z in zip(k.start[use].tolist(), k.end[use].tolist(), strict=True)]
                quarters += q
            return [np.concatenate(h), codes, quarters] if h else [[], [], []]

        return f

    rows = marked(df.select("doc_id", "text"), wanted, make, "h long, codes binary, quarters array<long>", max_keys)
    return materialize(rows.groupBy("h").agg(F.first("codes").alias("codes"), F.first("quarters").alias("quarters")), "tokens")


def alike(cols: dict, start: np.ndarray, size: np.ndarray):
    """(h, h) arrays that join up the lines of each group that agree in half of their places."""
    for s, k in zip(start.tolist(), size.tolist(), strict=True):
        if k < 2:
            continue
        codes, h = cols["codes"][s : s + k], cols["h"][s : s + k]
        if len(set(map(len, codes))) > 1:  # lines of other counts by a clash of hashes
            n = np.array([len(c) for c in codes])
            for x in np.unique(n):
                at = np.flatnonzero(n == x)
                yield from alike({"codes": [codes[i] for i in at], "h": h[at]}, np.zeros(1, np.int64), np.array([len(at)]))
            continue
        x = np.frombuffer(b"".join(codes), np.uint32).reshape(k, -1)
        n = x.shape[1]
        like = 2 * (x == x[0]).sum(1) >= n
        yield np.full(int(like.sum()), h[0]), h[like]
        rest = np.flatnonzero(~like)
        step = max(1, CELLS // (k * n))
        for i in range(0, len(rest), step):
            part = rest[i : i + step]
            a, b = np.nonzero(2 * (x[part][:, None] == x[None]).sum(2) >= n)
            yield h[part[a]], h[b]


def apart(cols: dict, start: np.ndarray, size: np.ndarray):
    """(h, h) arrays of lines of either side that agree in half of their places and are of different templates c."""
    for s, k in zip(start.tolist(), size.tolist(), strict=True):
        codes, h, c = (cols[n][s : s + k] for n in ("codes", "h", "c"))
        m, n = int(np.searchsorted(cols["side"][s : s + k], 1)), np.array([len(x) for x in codes])
        for length in np.intersect1d(n[:m], n[m:]).tolist():
            left, right = np.flatnonzero(n[:m] == length), m + np.flatnonzero(n[m:] == length)
            x, y = (np.frombuffer(b"".join(codes[at]), np.uint32).reshape(len(at), -1) for at in (left, right))
            step = max(1, CELLS // y.size)
            for i in range(0, len(x), step):
                a, b = np.nonzero(2 * (x[i : i + step, None] == y[None]).sum(2) >= x.shape[1])
                a, b = left[i + a], right[b]
                other = c[a] != c[b]
                yield h[a[other]], h[b[other]]


def across(large: DataFrame, first: DataFrame, tokens: DataFrame) -> DataFrame:
    """a, b: links of lines of one sliced group (sub, slices, slice, h) that `first` leaves in different templates: one of them at least is outside of the group's largest."""
    joined = components(first, materialize).select(F.col("node").alias("h"), "component")
    named = materialize(large.join(joined, "h", "left").select("sub", "slices", "slice", "h", F.coalesce("component", "h").alias("c")), "named")
    top = named.groupBy("sub", "c").agg(F.count("*").alias("k")).groupBy("sub").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.sum("k").alias("rows"), (F.sum("k") - F.max("k")).alias("minor"))
    top = materialize(top.where("minor > 0").withColumn("blocks", F.ceil(F.col("minor") / GROUP).cast("int")), "top")
    named = joined_first(named, top, "sub").where("top is not null")
    pick = lambda df, block, slice_, side: df.select("sub", block.alias("block"), slice_.alias("slice"), F.lit(side).alias("side"), "h", "c")
    left = pick(named.where("c <> top").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "h"), F.col("blocks")).cast("int")), F.col("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), 0)
    right = pick(named, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.col("slice"), 1)
    return by_cell(left.unionByName(right).join(tokens.select("h", "codes"), "h"), ["sub", "block", "slice"], apart)


def generalised(plain: DataFrame, lines: DataFrame, max_keys: int) -> DataFrame | None:
    """h, template of the long lines that are like others; None if there are none. lines: h, first, branches of each distinct long line."""
    rows = lines.select("h", "first", F.posexplode("branches").alias("depth", "branch"))
    mixed = materialize(rows.groupBy("branch").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("several", F.lit(True)), "mixed")
    rows = materialize(joined_first(rows, mixed, "branch").where("several").select("h", "first", "depth", "branch"), "mixed_lines")
    wanted = materialize(rows.select("h").distinct(), "wanted")
    if not wanted.limit(1).count():
        return None
    tokens = token_table(plain, wanted, max_keys)
    sub = F.when(F.col("depth") > 0, F.array("branch")).otherwise(F.transform("quarters", lambda q, k: F.xxhash64(F.col("branch"), q, k)))
    rows = rows.join(tokens.select("h", "quarters"), "h").select("h", "first", F.explode(sub).alias("sub")).distinct()
    rows = materialize(rows, "candidates")
    firsts = rows.groupBy("sub").agg(F.count("*").alias("rows"), F.min_by("h", F.struct(F.col("first").isNull(), "first", "h")).alias("rep")).where("rows > 1")
    firsts = materialize(firsts.withColumn("slices", F.ceil(F.col("rows") / GROUP).cast("int")), "groups")
    rows = joined_first(rows, firsts, "sub").where("rep is not null").select("sub", "slices", F.pmod(F.xxhash64("h"), F.col("slices")).cast("int").alias("slice"), "h")
    large = firsts.where("slices > 1")
    also = large.select("sub", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("rep").alias("h"))
    sliced = rows.drop("slices").unionByName(also).distinct().join(tokens.select("h", "codes"), "h")
    links = materialize(by_cell(sliced, ["sub", "slice"], alike), "alike")
    if large.limit(1).count():
        links = materialize(links.unionByName(across(rows.where("slices > 1"), links, tokens)), "alike")
    return components(links, materialize).select(F.col("node").alias("h"), F.col("component").alias("template"))


def recurring(df: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """h, first, template: the keys of recurring templates' lines, the document that keeps them, and the template."""
    rows = materialize(postings(df), "postings")
    lines = rows.groupBy("h").agg(F.count("*").alias("docs"), F.min("tokens").alias("tokens"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("branches").alias("branches"))
    lines = materialize(lines, "lines")
    need = F.when(F.col("tokens") >= LONG_RUN, 2).when(F.col("tokens") >= LONG, 3).otherwise(10)
    recurs = (F.col("docs") >= need) & (F.col("first").isNull() | (F.col("first") != F.col("last")))
    like = generalised(df, lines.where("branches is not null").select("h", "first", "branches"), max_keys)
    if like is None:
        return lines.where(recurs).select("h", "first", F.col("h").alias("template"))
    like = joined_first(lines.select("h", "docs", "tokens", "first", "last"), materialize(like.withColumn("rows", F.lit(1)), "like"), "h")
    alone = like.where("template is null").where(recurs).select("h", "first", F.col("h").alias("template"))
    many = materialize(like.where("template is not null").select("h", "tokens", "template", F.col("docs").alias("rows")), "many")
    own = joined_first(rows.select("h", "doc_id"), many, "h").where("template is not null").select("template", "tokens", "doc_id").distinct()
    stats = own.groupBy("template").agg(F.count("*").alias("docs"), F.min("tokens").alias("tokens"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(recurs)
    return alone.unionByName(many.select("h", "template").join(stats.select("template", "first"), "template").select("h", "first", "template"))


def cleaned(texts: list[str | None], drop, state: dict) -> list[tuple]:
    """(text without the lines of the keys that drop(keys, place of the first text) names, lines, lines dropped, whether little and whether none of it is left) of each text."""
    out: list[tuple] = []
    for start, part in parted(texts):
        k = Keys(part, state)
        go = drop(k, start)
        step = np.zeros(k.base[-1] + 1, np.int64)
        np.add.at(step, k.first[go], 1)
        np.add.at(step, k.last[go] + 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        touched = set(k.doc[go].tolist())
        for d, t in enumerate(part):
            a, b = int(k.base[d]), int(k.base[d + 1])
            if texts[start + d] is None:
                out.append((None, 1, 0, False, False))
            elif d not in touched:
                out.append((t, b - a, 0, False, False))
            else:
                split = t.split("\n")
                drops = [g and bool(x.strip(" \t\n\r\x0b\x0c")) for x, g in zip(split, gone[a:b].tolist(), strict=True)]
                kept = [x for x, g in zip(split, drops, strict=True) if not g]
                words, left = (sum(len(x.encode("utf-8", "surrogatepass").split()) for x in y) for y in (split, kept))
                out.append(("\n".join(kept), b - a, sum(drops), KEEP_DEN * left < KEEP_NUM * words, not left))
    return out


RESULT = "text:string,n_lines:int,n_dropped:int,copy:boolean,bare:boolean"


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", max_keys: int = MAX_KEYS) -> DataFrame:
    """row (all columns of df), and new: the text without recurring lines, n_lines, n_dropped, copy, bare."""
    plain = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rec = materialize(recurring(plain, max_keys).select("h", "first"), "templates")
    size = rec.count()
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), whole(df).alias("row"))
    new = [F.col(f.name) for f in schema(RESULT.replace(":", " "))]
    shaped = lambda got: got.select("row", F.struct(*new).alias("new"))
    if size > max_keys:
        marks = postings(plain).join(rec, "h").where(~F.col("first").eqNullSafe(F.col("doc_id")))
        marks = marks.groupBy(F.col("doc_id").alias("m_id")).agg(F.collect_set("h").alias("gone"))
        rows = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")), "left").select("doc_id", "text", "row", "gone")

        def make():
            state: dict = {}

            def g(c):
                def drop(k, start):
                    go = np.zeros(len(k.key), bool)
                    for d in set(k.doc.tolist()):
                        if c[2][start + d]:
                            at = np.flatnonzero(k.doc == d)
                            go[at] = np.isin(k.key[at].view(np.int64), np.array(c[2][start + d], np.int64))
                    return go

                return list(zip(*cleaned(c[1], drop, state), strict=True))

            return g

        return shaped(map_beside(rows.select("row", "doc_id", "text", "gone"), make, schema(RESULT.replace(":", " "))))
    table = rec.toArrow()
    h = table["h"].to_numpy() if size else np.empty(0, np.int64)
    order = np.argsort(h)
    first = (table["first"].fill_null(np.iinfo(np.int64).max).to_numpy() if size else np.empty(0, np.int64))[order]
    shared = df.sparkSession.sparkContext.broadcast((h[order], first))

    def make():
        h, first = shared.value
        state: dict = {}

        def g(c):
            ids = np.array([np.iinfo(np.int64).max if k is None else k for k in c[0]], np.int64)

            def drop(k, start):
                if not len(h):
                    return np.zeros(len(k.key), bool)
                own = k.key.view(np.int64)
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                return (h[at] == own) & (first[at] != ids[start + k.doc])

            return list(zip(*cleaned(c[1], drop, state), strict=True))

        return g

    return shaped(map_beside(rows.select("row", "doc_id", "text"), make, schema(RESULT.replace(":", " "))))


def templates(df: DataFrame, key: str = "doc_id", text: str = "text", max_keys: int = MAX_KEYS) -> DataFrame:
    """template, docs, first: the recurring templates of long lines with <*> for what varies; the tokens that all lines of one share are learnt by Spark, place by place."""
    plain = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rec = materialize(recurring(plain, max_keys), "templates")

    def make(only):
        state: dict = {}

        def f(c):
            h, ids, at, token = [], [], [], []
            for doc, t in zip(*c, strict=True):
                if not t:
                    continue
                k, split = Keys([t], state), t.split("\n")
                own, line = k.key[k.long].view(np.int64), k.first[k.long]
                for i in np.flatnonzero(among(own, only)).tolist():
                    words = split[int(line[i])].encode("utf-8", "surrogatepass").split()
                    h += [int(own[i])] * len(words)
                    ids += [doc] * len(words)
                    at += range(len(words))
                    token += ["<*>" if any(48 <= y <= 57 for y in w) else w.decode("utf-8", "replace") for w in words]
            return [h, ids, at, token]

        return f

    rows = marked(plain, rec.where("h is not null"), make, "h long, doc_id long, at int, token string", max_keys).join(rec.select("h", "template"), "h")
    places = rows.groupBy("template", "at").agg(F.min("token").alias("lo"), F.max("token").alias("hi"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first"))
    word = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("<*>")).alias("word")
    made = places.select("template", "at", "docs", "first", word).groupBy("template").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), F.max("docs").alias("docs"), F.min("first").alias("first"))
    return made.select(F.array_join(F.col("words.word"), " ").alias("template"), "docs", "first").distinct()


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without recurring lines, n_lines, n_dropped, copy (little of it is its own)."""
    got = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("row.doc_id", "new.text", F.col("new.n_lines").cast("long").alias("n_lines"), F.col("new.n_dropped").cast("long").alias("n_dropped"), "new.copy")


def templates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; only those of which no word is left go. The columns of docs, n_chars counted anew where lines went."""
    kept = dedup_lines(docs).where(~F.col("new.bare"))
    n = F.when(F.col("new.n_dropped") > 0, F.length("new.text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    made = {"text": F.col("new.text"), "n_chars": n}
    return kept.select(*((made[c].cast(docs.schema[c].dataType) if made.get(c) is not None else F.col("row").getField(c)).alias(c) for c in docs.columns))
