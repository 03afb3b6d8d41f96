"""Main text of HTML pages by tag-path ratios.

The text between two block-level tags is a unit; its path is the chain of block-level elements (with their
classes) from the root to it. Text length and punctuation are added up for each path and divided by its
units; both ratios are smoothed over neighbouring units in page order. A path's value is the geometric mean
of its own fused ratio (length times punctuation) and of the mean of its smoothed ones, times the spread of its
units' lengths (paragraphs differ, single notices don't), less what is links; the paths that reach LEAST times the
mean value of all text are selected. The article is the smallest
element that holds all selected units, and all text in it is returned. Of an element that holds more than the
article (menus, say), only the parts that hold selected units are.

Names come after. Of selected units, those in a part that is called sidebar, comments, notice and the like, by
element or by the head word of a class, id or role, do not count, unless little is selected outside of it: then
the name is taken to mislead. Parts called search, social, share and the like go by their ratio, which the name moves. An article or main element that holds half of what is selected is the article.

Cases: null html is empty; a page without such text gives an empty string; unclosed elements, comments, scripts
and quoted values end where the standard ends them (a page that ends inside a tag ends before it); stray
brackets are text; time and memory are linear in a page's length; equal pages give equal texts.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, schema

LEAST, REACH, TRUST_CHARS, TRUST_SHARE, TIP, OUTER = 0.3, 2, 200, 0.25, 2.0, 0.6

# Element names of the HTML standard, by how they are treated here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = ("ul", "ol", "dl", "table", "td", "th", "div", "article", "section", "body", "main", "aside", "nav", "header", "footer", "form", "blockquote")
BARRIER = ("article", "main", "table", "body")
# Never shown as text, or controls.
NEVER = frozenset("head select datalist script style noscript template iframe svg math object button menu textarea title canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, and words of class, id and role, that name a part beside the article.
BESIDE = frozenset("nav footer aside form dialog header".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus "
    "reply replies respond related recommended share sharing social widget login search pagination pager toolbar skip contentinfo complementary dialog form".split()
)
HEADERS = frozenset(["header", "topbar"])
# Of these, names of parts that hold text of the article often enough: such a part goes by its ratio, which counts TIP times in an article or main element, OUTER times elsewhere.
TIPPED = frozenset("search social share sharing dialog widget alert".split())
# Words after the one that says what a part is (ad-slot, comment-list), and before it, if it says what a page has (no-sidebar).
PLACES = frozenset("area areas articles bar block body bottom box buttons button container content group icons inner item items left link links list main outer panel posts right section slot top trail unit wrap wrapper".split())
STATES = frozenset("disable disabled enable enabled has have hide is no non not show with without".split())
PUNCTUATION = re.compile(r"[.,;:!?。，；！？]")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(=?[^\s/>=]*)(\s*=\s*)?)")
_VALUE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Za-z]+")
_KERNEL = [math.exp(-k * k / 2) for k in range(-REACH, REACH + 1)]


class Element:
    """number, last: place of the element and of its last descendant in page order. mark: the nearest marked element around it or itself; holder: the same for article and main."""

    __slots__ = ("tag", "parent", "number", "last", "block", "path", "never", "article", "link", "mark", "holder", "tipped")

    def __init__(self, tag, parent, number, path):
        self.tag, self.parent, self.number, self.path, self.last = tag, parent, number, path, math.inf
        self.block, self.tipped = parent.block if tag in INLINE else self, False
        self.never, self.article, self.link, self.mark, self.holder = (parent.never, parent.article, parent.link or tag == "a", parent.mark, parent.holder) if parent else (False, False, False, None, None)


class Unit:
    """Text between two block-level tags."""

    __slots__ = ("element", "parts", "chars", "marks", "links")

    def __init__(self, element):
        self.element, self.parts, self.chars, self.marks, self.links = element, [], 0, 0, 0


def head(name: str) -> str:
    """The word of a class or id that says what the element is: the last but for PLACES; none where it says what a page has."""
    words = [w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name))]
    while len(words) > 1 and words[-1] in PLACES:
        words.pop()
    return words[-1] if words and words[0] not in STATES else ""


def attributes(page: str, at: int) -> tuple[dict[str, str] | None, int]:
    """Attributes and the place after the tag's end; None if the page ends first."""
    out: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        at, n = m.end(), len(page)
        value = ""
        if m[2]:
            quote = page[at] if at < n else ""
            if quote and quote in "\"'":
                end = page.find(quote, at + 1)
                if end < 0:
                    return None, n
                value, at = page[at + 1 : end], end + 1
            else:
                v = _VALUE.match(page, at)
                value, at = v[0], v.end()
        if m[1]:
            out.setdefault(m[1].lower(), value)
        if at >= n:
            return None, n
        if page[at] == ">":
            return out, at + 1


class Reader:
    """One pass over a page: units, and elements in page order."""

    def __init__(self, page: str):
        self.root = Element("", None, 0, 0) if page is not None else None
        self.elements, self.stack, self.at_tag, self.paths = [self.root], [self.root], {}, {}
        self.units: list[Unit] = []
        self.unit: Unit | None = None
        self.read(page)

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not raw or top.never:
            return
        t = entities.unescape(raw) if "&" in raw else raw
        n = sum(map(len, t.split()))
        if self.unit is None:
            if not n:
                return
            self.unit = Unit(top.block)
            self.units.append(self.unit)
        u = self.unit
        u.parts.append(t)
        if n:
            u.chars, u.marks, u.links = u.chars + n, u.marks + len(PUNCTUATION.findall(t)), u.links + n * top.link

    def open(self, tag: str, a: dict[str, str]) -> Element:
        parent = self.stack[-1]
        classes = sorted(a["class"].split())[:2] if a.get("class") else ()
        key = (parent.path, tag, *classes)
        e = Element(tag, parent, len(self.elements), parent.path if tag in INLINE else self.paths.setdefault(key, len(self.paths) + 1))
        holds = tag in ("article", "main") or "main" in a.get("role", "").lower().split()
        e.article = parent.article or holds
        if holds:
            e.holder = e
        mark = tag in BESIDE and not (tag == "header" and parent.article)
        if a and not mark and tag not in ("body", "html", "main"):
            named = ("class", "role") if parent.article and (tag == "p" or tag in HEADINGS) else ("class", "id", "role")
            heads = {head(x) for k in named for x in a.get(k, "").split()}
            mark = bool(heads & MARKS) or bool(heads & HEADERS) and not parent.article
            e.tipped = mark and parent.mark is None and not heads & (MARKS - TIPPED | HEADERS)
        if mark:
            e.mark = e
        e.never = parent.never or tag in NEVER or bool(a) and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower())
        self.elements.append(e)
        return e

    def push(self, e: Element) -> None:
        self.at_tag.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all in it."""
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.at_tag[e.tag].pop()
            e.last = len(self.elements) - 1

    def deepest(self, tags) -> int:
        return max((self.at_tag[t][-1] for t in tags if self.at_tag.get(t)), default=0)

    def close(self, tag: str) -> None:
        if places := self.at_tag.get(tag):
            if tag not in INLINE or places[-1] > self.deepest(BARRIER):
                self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """Elements that the start of this one ends."""
        ends = (*SAME.get(tag, ()), "p") if tag in CLOSES_P else SAME.get(tag, ())
        if not any(self.at_tag.get(t) for t in ends):
            return
        least = self.deepest([t for t in SCOPE if t not in ends])
        found = [places[k] for t in ends if (places := self.at_tag.get(t)) and (k := bisect_right(places, least)) < len(places)]
        if found:
            self.cut(min(found))

    def read(self, page: str) -> None:
        at, n, start = 0, len(page), 0
        while at < n:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= n:
                break
            c = page[lt + 1]
            if c in "!?":
                self.text(page[start:lt])
                if page.startswith("<!--", lt):
                    end = lt + 4 if page.startswith((">", "->"), lt + 4) else min((x for x in (page.find("-->", lt + 4), page.find("--!>", lt + 4)) if x >= 0), default=n)
                    end = page.find(">", end)
                else:
                    end = page.find(">", lt)
                at = start = end + 1 if end >= 0 else n
                continue
            closing = c == "/"
            m = _NAME.match(page, lt + 1 + closing)
            if not m:
                if closing and lt + 2 < n:  # </ and no name: a comment
                    self.text(page[start:lt])
                    end = page.find(">", lt)
                    at = start = end + 1 if end >= 0 else n
                else:
                    at = lt + 1
                continue
            self.text(page[start:lt])
            tag = m[0].lower()
            if m.end() < n and page[m.end()] == ">":
                a, end = {}, m.end() + 1
            else:
                a, end = attributes(page, m.end())
            at = start = end
            if a is None:
                break
            if tag not in INLINE:
                self.unit = None
            if closing:
                self.close(tag)
                continue
            if tag not in INLINE:
                self.make_room(tag)
            elif tag == "br":
                self.text(" ")
            if tag in VOID or page[end - 2] == "/" and tag in ("svg", "path"):
                continue
            e = self.open(tag, a)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if e.never:
                    at = start = close.end() if close else n
                    e.last = e.number
                    continue
            self.push(e)
        self.text(page[start:n] if at < n or start < n else "")


def smoothed(values: list[float]) -> list[float]:
    out, n = [], len(values)
    for i in range(n):
        lo, hi = max(0, i - REACH), min(n, i + REACH + 1)
        w = _KERNEL[lo - i + REACH : hi - i + REACH]
        out.append(sum(x * y for x, y in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def select(units: list[Unit], least: float = LEAST) -> tuple[list[bool], list[bool]]:
    """Whether the path of each unit is selected by its fused, smoothed ratios, and whether it is where they count TIP or OUTER times."""
    stats: dict[int, list[float]] = {}
    for u in units:
        s = stats.setdefault(u.element.path, [0, 0, 0, 0, 0, 0.0])
        s[0], s[1], s[2], s[3], s[4] = s[0] + 1, s[1] + u.chars, s[2] + u.marks, s[3] + u.links, s[4] + u.chars * u.chars
    paths = [u.element.path for u in units]
    length = smoothed([stats[p][1] / stats[p][0] for p in paths])
    marks = smoothed([stats[p][2] / stats[p][0] for p in paths])
    for p, x, y in zip(paths, length, marks, strict=True):
        stats[p][5] += x * (1 + y)
    value = {}
    for p, (k, c, m, links, squares, total) in stats.items():
        spread = math.sqrt(max(0.0, squares / k - (c / k) ** 2))
        value[p] = math.sqrt((c / k) * (1 + m / k) * (total / k)) * (1 + math.sqrt(spread)) * (1 - links / c)
    own = sum(u.chars - u.links for u in units)
    bar = least * sum(value[u.element.path] * (u.chars - u.links) for u in units) / own if own else 0.0
    return [value[p] >= bar and value[p] > 0 for p in paths], [(TIP if u.element.article else OUTER) * value[u.element.path] >= bar and value[u.element.path] > 0 for u in units]


def misleading(units: list[Unit], chosen: list[bool], elements: list[Element]) -> set[int]:
    """Numbers of the marked elements whose names mislead: they hold the most of what is selected, and little is selected outside marked ones."""
    held = dict.fromkeys((e.number for e in elements if e.mark is e), 0)
    total = plain = 0
    for u, ok in zip(units, chosen, strict=True):
        if ok:
            total += u.chars
            if u.element.mark is None:
                plain += u.chars
            else:
                held[u.element.mark.number] += u.chars
    if plain >= min(TRUST_CHARS, TRUST_SHARE * total) and plain or any(u.element.article and u.element.mark is None for u in units):
        return set()
    for k in sorted(held, reverse=True):
        outer = elements[k].parent.mark
        if outer is not None:
            held[outer.number] += held[k]
    return {k for k, n in held.items() if 2 * n > total}


def article(units: list[Unit], chosen: list[bool], elements: list[Element]) -> Element:
    """The smallest element around all chosen units; an article or main element that holds half of them."""
    held = dict.fromkeys((e.number for e in elements if e.holder is e), 0)
    total = 0
    for u, ok in zip(units, chosen, strict=True):
        if ok:
            total += u.chars
            if u.element.holder is not None:
                held[u.element.holder.number] += u.chars
    for k in sorted(held, reverse=True):
        outer = elements[k].parent.holder
        if outer is not None:
            held[outer.number] += held[k]
    if most := [k for k, n in held.items() if n == total]:
        return elements[max(most)]
    if most := [k for k, n in held.items() if 2 * n >= total]:
        return elements[min(most)]
    own = [u.element for u, ok in zip(units, chosen, strict=True) if ok]
    best, last = own[0], max(e.number for e in own)
    for e in own:
        if e.number < best.number:
            best = e
    while best.last < last or best.tag in HEADINGS or best.tag in ("p", "li", "dd", "dt", "td", "th", "tr", "tbody", "pre") and best.parent:
        best = best.parent
    return best


def parts(units: list[Unit], chosen: list[bool], best: Element, elements: list[Element]) -> list[bool]:
    """Which units belong to the article. What is more than an article holds menus: there, only parts with chosen units do, headings, and what stands between paragraphs."""
    inside = [best.number <= u.element.number <= best.last for u in units]
    if best.holder is best:
        return inside
    own = [u for u, x in zip(units, inside, strict=True) if x]
    if not any(u.links >= u.chars * 0.9 or u.element.mark not in (None, best.mark) for u in own) and best.tag not in ("", "html", "body"):
        return inside
    starts = [e.number for e in elements if e.parent is best]
    part = [bisect_right(starts, u.element.number) if u.element is not best else 0 for u in units]
    holding = {k for k, x, ok in zip(part, inside, chosen, strict=True) if x and ok}
    flat = {elements[starts[k - 1]].tag == "p" if k else True for k in holding} == {True}
    places = [i for i, (x, ok) in enumerate(zip(inside, chosen, strict=True)) if x and ok]
    out = []
    for i, (u, x, k) in enumerate(zip(units, inside, part, strict=True)):
        between = flat and places[0] < i < places[-1]
        title = u.element.tag in HEADINGS and u.element.parent is best
        out.append(x and (k in holding or u.links < 0.5 * u.chars and (between or title)))
    return out


def menu(units: list[Unit]) -> list[bool]:
    """Runs of three units or more that are nothing but links."""
    out, run = [False] * len(units), 0
    for i, u in enumerate(units):
        run = run + 1 if u.links == u.chars else 0
        if run >= 3:
            out[i] = out[i - 1] = out[i - 2] = True
    return out


def main_text(page: str | None, least: float = LEAST) -> str:
    reader = Reader(page or "")
    units, elements = reader.units, reader.elements
    if not units:
        return ""
    chosen, clear = select(units, least)
    ours = misleading(units, chosen, elements)
    beside = {}
    for e in elements:
        if e.mark is e:
            outer = e.parent.mark
            beside[e.number] = e.number not in ours or outer is not None and beside[outer.number]
    marked = [u.element.mark is not None and beside[u.element.mark.number] and not (c and u.element.mark.tipped) for u, c in zip(units, clear, strict=True)]
    chosen = [ok and not m for ok, m in zip(chosen, marked, strict=True)]
    if not any(chosen):  # nothing stands out
        chosen = [not m and u.links < u.chars for u, m in zip(units, marked, strict=True)]
        inside = [x and u.element.article for u, x in zip(units, chosen, strict=True)]
        chosen = inside if any(inside) else chosen
    if not any(chosen):
        return ""
    best = article(units, chosen, elements)
    kept = parts(units, chosen, best, elements)
    menus = menu(units) if best.holder is not best else [False] * len(units)
    out = []
    for u, x, m, ok, links in zip(units, kept, marked, chosen, menus, strict=True):
        if x and not m and (ok or not links):
            out.append(" ".join("".join(u.parts).split()))
    return "\n".join(t for t in out if t)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, url)}

    def make():
        return lambda c: [c[0], c[1], [main_text(h) for h in c[2]]]

    return map_rows(df.select(key, url, html), make, schema(f"{key} {kinds[key]}, {url} {kinds[url]}, text string"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.selectExpr("page_id", "url", "text", "cast(length(text) as long) as n_chars")
