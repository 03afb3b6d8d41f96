"""Personal data by weak supervision, with DataFrame functions alone.

Candidates are matches of the base patterns (valid or not) and of looser ones. Labelers vote on
each: a regex labeler (strict form), a gazetteer labeler (issuer prefixes, reserved networks,
top-level domains, area codes), a labeler for the words before the span and one for its edges.
Votes are 1 (personal), 0 (not) or -1 (abstains). Spark counts the vote patterns (81 a
kind at most); expectation-maximisation on these counts estimates each labeler's reliability.
Its posteriors are soft labels for the final classifier, a naive Bayes model on the span's
features, whose table of log ratios (bounded: votes, kind, lengths, neighbouring characters) is a
literal in the plan. Base spans always stay; other candidates are added when the classifier
gives 0.5 or more.

Cases: null and empty texts have no spans; very long texts are scanned whole with patterns that
neither recurse nor backtrack without bound, and offsets are added up in blocks of matches; repeated rows get equal results; without
candidates the reliabilities are the priors; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_like", "card_like", "phone_like", "ssn_like")
VOTES = ("v_regex", "v_gazetteer", "v_context", "v_edges")
BEFORE, BLOCK, ROUNDS, PRIOR = 48, 128, 50, 0.5

# Java patterns. \G and the look-behinds start a match only where the plain pattern's leftmost one can start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
EMAIL_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}+)++"
PHONE_LIKE = r"(?<![0-9+.(-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
SSN_LIKE = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Gazetteers: fixed values.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl be ch at us ca au jp cn br in ru pl se no fi dk pt ie eu example test invalid localhost".split()
NEAR = r"(?i)\b(?:e-?mails?|mail|contact|write|phone|tel|telephone|mobile|cell|call|fax|card|visa|mastercard|amex|credit|payment|ip|host|server|address|ssn|social|reach|telefon|correo|courriel|tarjeta|karte|carte)\b"
FAR = r"(?i)\b(?:version|release|order|invoice|isbn|issn|doi|sku|part|serial|build|commit|ref|reference|page|section|figure|equation)\b"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, left, right>> of all matches; offsets count code points, ends are exclusive.

    before: up to BEFORE characters since the match before; left and right: the neighbouring ones.
    """
    kind = "struct<start:int,end:int,value:string,before:string,left:string,right:string>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -BEFORE, BEFORE).alias("tail"), F.substring(g, 1, 1).alias("head")))
    n = F.size(found)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), found.alias("value"), F.slice(gaps, F.lit(2), n).alias("next"))

    def step(acc, r):
        gap, value = r["gap"], r["value"]
        begin = acc.at + gap["n"]
        left = F.when(gap["n"] > 0, F.substring(gap["tail"], -1, 1)).otherwise(acc["last"])
        one = F.struct(begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value"), gap["tail"].alias("before"), left.alias("left"), r["next"]["head"].alias("right"))
        return F.struct((begin + F.length(value)).alias("at"), F.substring(value, -1, 1).alias("last"), F.concat(acc.out, F.array(one)).alias("out"))

    def block(acc, part):
        """An array that grows is copied each time, so that only those of a block of rows grow."""
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), acc["last"].alias("last"), F.array().cast(f"array<{kind}>").alias("out")), step)
        return bound(inner, lambda i: F.struct(i["at"].alias("at"), i["last"].alias("last"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    def whole(r):
        cuts = F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int"))
        blocks = F.when(F.size(r) > 0, F.transform(cuts, lambda k: F.slice(r, k * BLOCK + 1, F.lit(BLOCK))))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.coalesce(F.aggregate(blocks, start, block, lambda acc: F.flatten(acc.out)), F.array().cast(f"array<{kind}>"))

    return bound(rows, whole)


def bound(value: Column, f) -> Column:
    """f(value), with value made once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.split(F.reverse(digits(value)), "")
    total = F.aggregate(F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 1, (2 * x.cast("int")) % 10 + F.floor(x.cast("int") / 5).cast("int")).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def base_ok(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return {
        "email": F.lit(True), "ip": value.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": n.between(16, 19) & luhn(value), "phone": n.between(8, 15),
    }[kind]


def gazetteer(kind: Column, value: Column) -> Column:
    """1, 0 or -1 by lists of known prefixes, networks and domains."""
    d = digits(value)
    return (
        F.when(kind.isin("email", "email_like"), F.when(F.lower(F.substring_index(F.substring_index(F.regexp_replace(value, r"[ )\]]", "."), ".", -1), "@", -1)).isin(DOMAINS), 1).otherwise(0))
        .when(kind == "ip", F.when(value.rlike(r"^(?:0|127|255)\.|^(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"), 0).otherwise(1))
        .when(kind.isin("card", "card_like"), F.when(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), 1).otherwise(0))
        .when(kind.isin("phone", "phone_like"), F.when(d.rlike("^(?:0|1[01]|[01]{3})"), 0).otherwise(1))
        .otherwise(F.when(value.rlike("^(?:000|666|9)"), 0).otherwise(1))
    )


def described(kind: str, spans: Column, base: bool) -> Column:
    """Votes and features of each span."""
    name = F.lit(kind)

    def one(s):
        value, start, before, left, right = (s[x] for x in ("value", "start", "before", "left", "right"))
        ok = base_ok(kind, value) if base else F.lit(False)
        shown = F.when(ok, name).otherwise(F.lit({"email": "email_like", "ip": "ip_like", "card": "card_like", "phone": "phone_like"}.get(kind, kind)))
        edge = lambda c: F.when(c == "", "none").when(c.rlike(r"^\s$"), "space").when(c.rlike("^[A-Za-z0-9_]$"), "word").otherwise("mark")
        glued = (edge(left) == "word") | (edge(right) == "word")
        return F.struct(
            shown.alias("kind"), start.alias("start"), s["end"].alias("end"), ok.alias("base"),
            (F.when(ok, 1).otherwise(0) if base else F.lit(-1)).alias("v_regex"),
            gazetteer(name, value).alias("v_gazetteer"),
            F.when(before.rlike(NEAR), 1).when(before.rlike(FAR), 0).otherwise(-1).alias("v_context"),
            F.when(glued, 0).otherwise(1).alias("v_edges"),
            F.least(F.length(value), F.lit(40)).alias("length"), F.least(F.length(digits(value)), F.lit(24)).alias("digits"),
            edge(left).alias("left"), edge(right).alias("right"),
        )

    return F.transform(spans, one)


STRUCT = "struct<kind:string,start:int,end:int,base:boolean,v_regex:int,v_gazetteer:int,v_context:int,v_edges:int,length:int,digits:int,left:string,right:string>"


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: every candidate with its votes and features. A narrow projection."""
    t = F.col("text")
    none = F.array().cast(f"array<{STRUCT}>")
    has_digits = t.rlike("[0-9][ -]?[0-9]")
    parts = []
    for kind, pattern, base, may in (
        ("email", EMAIL, True, t.contains("@")), ("ip", IP, True, t.rlike(r"[0-9]\.[0-9]")), ("card", CARD, True, has_digits), ("phone", PHONE, True, t.contains("+")),
        ("email_like", EMAIL_LIKE, False, t.contains("(at)") | t.contains("[at]")), ("phone_like", PHONE_LIKE, False, has_digits), ("ssn_like", SSN_LIKE, False, has_digits & t.contains("-")),
    ):
        parts.append(F.when(may & t.rlike(pattern), described(kind, matches(t, pattern), base).cast(f"array<{STRUCT}>")).otherwise(none))
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.select("doc_id", F.concat(*parts).alias("spans"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[list[list[float]]], dict]:
    """EM over (votes, count): the share of personal spans, P(vote | class) of each labeler, and each pattern's posterior."""
    labelers = len(VOTES)
    share = PRIOR
    table = [[[0.3, 0.4, 0.3], [0.3, 0.1, 0.6]] for _ in range(labelers)]  # class 0, 1; votes -1, 0, 1
    post: dict = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            one, zero = math.log(share), math.log(1 - share)
            for k, v in enumerate(votes):
                one, zero = one + math.log(table[k][1][v + 1]), zero + math.log(table[k][0][v + 1])
            post[votes] = 1 / (1 + math.exp(max(-700.0, min(700.0, zero - one))))
        total = sum(n for _, n in patterns)
        if not total:
            break
        share = (sum(n * post[v] for v, n in patterns) + 1) / (total + 2)
        for k in range(labelers):
            for c in (0, 1):
                sums = [1.0, 1.0, 1.0]
                for votes, n in patterns:
                    sums[votes[k] + 1] += n * (post[votes] if c else 1 - post[votes])
                table[k][c] = [x / sum(sums) for x in sums]
    return share, table, post


FEATURES = ("kind", *VOTES, "length", "digits", "left", "right")


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    """feature=value -> log ratio, and the prior's log odds. What reaches the driver: vote patterns and feature values."""
    rows = found.select(F.explode("spans").alias("s")).select("s.*")
    patterns = [(tuple(r[v] for v in VOTES), r["count"]) for r in rows.groupBy(*VOTES).count().collect()]
    share, _, post = reliabilities(sorted(patterns))
    if not post:
        return {}, 0.0
    soft = F.create_map(*(F.lit(x) for v, p in sorted(post.items()) for x in (",".join(map(str, v)), p)))
    named = rows.withColumn("p", F.element_at(soft, F.concat_ws(",", *VOTES)))
    pairs = F.explode(F.array(*(F.concat_ws("=", F.lit(f), F.col(f).cast("string")) for f in FEATURES))).alias("feature")
    sums = named.select("p", pairs).groupBy("feature").agg(F.sum("p").alias("one"), F.sum(1 - F.col("p")).alias("zero")).collect()
    n1, n0 = (sum(x) / len(FEATURES) for x in zip(*((r.one, r.zero) for r in sums), strict=True))
    ratio = {r.feature: round(math.log((r.one + 1) / (n1 + 2)) - math.log((r.zero + 1) / (n0 + 2)), 6) for r in sums}
    return ratio, round(math.log((n1 + 1) / (n0 + 1)), 6)


def classify(found: DataFrame, ratio: dict[str, float], prior: float) -> DataFrame:
    """doc_id, spans with score; base spans and those of 0.5 or more, by kind as listed, then start."""
    table = F.create_map(*(F.lit(x) for kv in sorted(ratio.items()) for x in kv)) if ratio else None

    def score(s):
        if table is None:
            return F.lit(0.5)
        z = F.lit(prior)
        for f in FEATURES:
            z = z + F.coalesce(F.element_at(table, F.concat_ws("=", F.lit(f), s[f].cast("string"))), F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    order = F.array(*(F.lit(k) for k in (*KINDS, "ip_like")))
    scored = F.transform("spans", lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), score(s).alias("score")))
    return found.select("doc_id", F.array_sort(F.filter(scored, lambda s: s["base"] | (s["score"] >= 0.5))).alias("spans"))


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = materialize(candidates(df, key, text), "candidates")
    return classify(found, *train(found))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_personal(documents(spark, sf_dir))
    label = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *map(count, BASE), F.sha2(label(F.filter("spans", lambda s: s.base)), 256).alias("base_sha256"), label(F.col("spans")).alias("spans"))
