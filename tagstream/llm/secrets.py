"""Secret scan with multipart credential linking.

Strong kinds (always reported): assign, access, hex. Weak candidates are reported only where
complementary parts co-occur: access identifiers, secrets and endpoints are intervals inside
scopes (blocks between blank lines), joined when at most `reach` code points lie between them.
  weak    a 40-character base64-like run; needs an identifier or an endpoint nearby
  ident   a user or client name given as key=value; needs a secret nearby
  url     an endpoint, scheme://host...; needs an identifier and a secret nearby

Cases: null and empty texts have no spans; ties (equal starts) sort by kind as listed below;
repeated rows give repeated results; offsets count code points of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, schema

KINDS = ("assign", "access", "hex", "weak", "ident", "url")
REACH = 400

_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{38,}={0,2}(?![A-Za-z0-9+/=])")
_IDENT = re.compile(r"(?ai:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})")
_HOST = re.compile(r"://[A-Za-z0-9.-]+(?::[0-9]+)?")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_SCOPE = re.compile(r"\n[ \t]*\n")
_KEYS = ("pass", "secret", "token", "api")
_NAMES = ("user", "login", "client", "account")


def _runs(letters: str) -> bytes:
    return bytes(1 if chr(i) in letters else 0 for i in range(256))


_HEX_MAP = _runs("0123456789abcdef")
_B64_MAP = _runs("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=")


def base_spans(text: str, raw: bytes, low: bytes) -> list[tuple[str, int, int]]:
    out = []
    if any(k.encode() in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\1" * 24 in raw.translate(_HEX_MAP):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def weak_spans(text: str, raw: bytes, low: bytes) -> list[tuple[str, int, int]]:
    out = []
    if b"\1" * 38 in raw.translate(_B64_MAP):
        for m in _WEAK.finditer(text):
            x = m[0].rstrip("=")
            if re.search("[A-Z]", x) and re.search("[a-z]", x) and re.search("[0-9]", x):
                out.append(("weak", m.start(), m.end()))
    if any(k.encode() in low for k in _NAMES):
        out += [("ident", m.start(), m.end()) for m in _IDENT.finditer(text)]
    if b"://" in raw:
        out += urls(text)
    return out


def linked(text: str, strong: list, weak: list, reach: int) -> list[tuple[str, int, int]]:
    """Those of weak whose complements lie within reach in the same scope: the nearest part that ends before a span, and the nearest that starts after it, decide."""
    if not weak:
        return []
    breaks = [m.start() for m in _SCOPE.finditer(text)]
    sides = {"access": "ids", "ident": "ids", "assign": "keys", "hex": "keys", "weak": "keys", "url": "ends"}
    starts, ends = {}, {}
    for s in (*strong, *weak):  # no part holds a line end, so all of it is in one scope
        at = (sides[s[0]], bisect_right(breaks, s[1]))
        starts.setdefault(at, []).append(s[1])
        ends.setdefault(at, []).append(s[2])
    for v in (*starts.values(), *ends.values()):
        v.sort()

    def near(span, name):
        at = (name, bisect_right(breaks, span[1]))
        if at not in starts:
            return False
        before, after = bisect_right(ends[at], span[1]) - 1, bisect_left(starts[at], span[2])
        return before >= 0 and ends[at][before] >= span[1] - reach or after < len(starts[at]) and starts[at][after] <= span[2] + reach

    kept = []
    for s in weak:
        by_id, by_key, by_end = near(s, "ids"), near(s, "keys"), near(s, "ends")
        if s[0] == "weak" and (by_id or by_end) or s[0] == "ident" and by_key or s[0] == "url" and by_id and by_key:
            kept.append(s)
    return kept


def urls(text: str) -> list[tuple[str, int, int]]:
    """scheme://host: found by its marks, as a pattern would look at a long run of letters again from each of them."""
    out, free, at = [], 0, text.find("://")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _SCHEME:
            start -= 1
        while start < at and not "a" <= text[start] <= "z":
            start += 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            out.append(("url", start, m.end()))
            free = m.end()
        at = text.find("://", max(at + 1, free))
    return out


def scan(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    strong = base_spans(text, raw, low)
    taken = {s[1:] for s in strong}
    weak = [s for s in weak_spans(text, raw, low) if s[1:] not in taken]
    return sorted([*strong, *linked(text, strong, weak, reach)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """key, spans array<struct<kind, start, end>>: a narrow map, no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        return lambda c: [c[0], [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t or "", reach)] for t in c[1]]]

    return map_rows(df.select(key, text), make, schema(f"{key} {kind}, spans array<struct<kind:string,start:long,end:long>>"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    label = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(label(base), 256).alias("base_sha256"), label(F.col("spans")).alias("spans"),
    )


def base_digest(text: str | None) -> str:
    """The contract's digest in plain Python, for tests."""
    t, out = text or "", []
    for kind, pattern, least, group in (
        ("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
    ):
        out += [(m.start(), KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest()
