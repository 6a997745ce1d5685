"""Main text and true title of a page, by statistics of its text and structure.

Plain Python on one page; ``operators.extract`` runs it over tables.
"""

from __future__ import annotations

import json
import math
import re
import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

from corpusloom.functions.html import Node, parse

#: Marks that count as punctuation: six of ASCII, all others of Unicode, and the wide tilde.
PUNCT = regex.compile(r"[,.!?;:～]|[^\x00-\x7F\P{P}]")
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = regex.compile(f"[{_WS}]")
SPACES = regex.compile(f"[{_WS}]+")
EDGES = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
SEPARATORS = "|-–—_/\\»«~"
TITLE_SPACE = " \t\n\r\xa0\u3000"
NOISE = frozenset("aside button footer form iframe nav noscript object script select style svg template textarea".split())
CANDIDATES = frozenset("article blockquote dd div figcaption li p pre section td th".split())
BREAKS = frozenset("article blockquote br caption dd div dl dt figcaption h1 h2 h3 h4 h5 h6 header hr li ol p pre section table tr ul".split())
NOT_PROSE = frozenset("aside dd dl dt footer form header nav ol select table tbody thead tr ul".split())


@dataclass(frozen=True)
class Options:
    """What of the scoring is switched off, for ablation."""

    no_punct: bool = False
    no_link: bool = False
    no_propagate: bool = False
    keep_attribution: bool = False


@dataclass(frozen=True)
class Affixes:
    """What a host's titles begin and end with."""

    prefix: str = ""
    suffix: str = ""

    def strip(self, title: str) -> str:
        t = title
        if self.prefix and t.startswith(self.prefix) and len(t) > len(self.prefix):
            t = t[len(self.prefix) :]
        if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix):
            t = t[: -len(self.suffix)]
        return t.strip(TITLE_SPACE + SEPARATORS)


#: What Python alone takes for space.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
#: Marks beyond ASCII, as the standard library's expressions look them up faster.
_WIDE_MARKS = PUNCT.findall("".join(map(chr, range(0x80, sys.maxunicode + 1))))
_WIDE = re.compile("[" + "".join(map(re.escape, _WIDE_MARKS)) + "]")
_IS_WIDE = np.zeros(sys.maxunicode + 1, bool)
_IS_WIDE[list(map(ord, _WIDE_MARKS))] = True
_SOLID = re.compile("[^" + "".join(map(re.escape, [*EDGES, *",.!?;:", *_WIDE_MARKS])) + "]+")


def collapse(s: str) -> str:
    if any(c in s for c in _NO_SPACE):
        return SPACES.sub(" ", s).strip(" ")
    return " ".join(s.split())


def content_chars(s: str) -> int:
    return len(s) - sum(map(s.count, "\t\n\v\f\r " if s.isascii() else EDGES))


def punct_count(s: str) -> int:
    plain = sum(map(s.count, ",.!?;:"))
    if s.isascii():
        return plain
    if len(s) < 100:
        return plain + len(_WIDE.findall(s))
    return plain + int(np.count_nonzero(_IS_WIDE[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]))


def fold(s: str) -> str:
    return _fold(s) if len(s) <= 300 else _fold.__wrapped__(s)


@lru_cache(4096)
def _fold(s: str) -> str:
    return "".join(_SOLID.findall(s)).lower()


def bigram_overlap(a: str, b: str) -> float:
    a, b = fold(a), fold(b)
    if len(a) < 2:
        return float(bool(a) and a in b)
    return sum(a[i : i + 2] in b for i in range(len(a) - 1)) / (len(a) - 1)


def affinity(candidate: str, title: str) -> float:
    c, t = fold(candidate), fold(title)
    if not c or not t:
        return 0.0
    return 0.5 if c == t else 1.0 if t.startswith(c) else 0.6 if c in t else 0.0


def length_fit(n: int) -> float:
    return 0.0 if n < 4 else 1.0 if n <= 60 else 0.5 if n <= 120 else 0.0


def title_segments(title: str) -> list[str]:
    for s in SEPARATORS[1:]:
        title = title.replace(s, "|")
    return [x for x in (p.strip(EDGES) for p in title.split("|")) if x]


def is_attribution(line: str) -> bool:
    return len(line) <= 120 and ("://" in line or "www." in line)


def normalize(s: str, keep_attribution: bool = False) -> str:
    lines = (collapse(x) for x in s.split("\n"))
    return "\n".join(x for x in lines if x and (keep_attribution or not is_attribution(x)))


def drop_leading_title(content: str, title: str) -> str:
    t = fold(title)
    lines = content.split("\n")
    n = 0
    while t and n < min(3, len(lines)):
        x = fold(lines[n])
        most = 2 * len(t)
        if x and not (x == t or (x in t and 4 <= len(x) <= most) or (t in x and len(x) <= most + 8)):
            break
        n += 1
    return "\n".join(lines[n:])


def headline(raw: str) -> str:
    """The headline of a JSON-LD block."""
    try:
        v = json.loads(raw.strip())
    except (ValueError, RecursionError):
        return ""

    def find(v, depth: int) -> str:
        if depth > 6:
            return ""
        if isinstance(v, list):
            return next((h for h in (find(e, depth + 1) for e in v) if h), "")
        if not isinstance(v, dict):
            return ""
        own = v.get("headline")
        if isinstance(own, str) and own.strip(EDGES):
            return own.strip(EDGES)
        return next((h for h in (find(v.get(k), depth + 1) for k in ("@graph", "mainEntity", "itemListElement")) if h), "")

    return find(v, 0)


def _hidden(n: Node) -> bool:
    if n.attrs.get("hidden"):
        return True
    style = n.attrs.get("style")
    flat = "".join(SPACES.split(style)).lower() if style else ""
    return "display:none" in flat or "visibility:hidden" in flat


def prune(root: Node) -> None:
    """Drop what cannot hold main text."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in NOISE or _hidden(c))]
        stack += [c for c in n.children if isinstance(c, Node)]


@dataclass
class Stats:
    chars: int = 0
    punct: int = 0
    links: int = 0
    elements: int = 0

    @property
    def link_rate(self) -> float:
        return self.links / self.chars if self.chars else 0.0


def _orders(root: Node) -> tuple[list[tuple[Node, bool]], list[Node]]:
    """Elements in document order, with whether they lie in a link; and children before parents."""
    down, after = [], []
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        n, linked, done = stack.pop()
        if done:
            after.append(n)
            continue
        linked = linked or n.tag == "a"
        down.append((n, linked))
        stack.append((n, linked, True))
        stack += [(c, linked, False) for c in reversed(n.children) if isinstance(c, Node)]
    return down, after


def text_stats(root: Node) -> tuple[dict[Node, Stats], list[Node]]:
    """Statistics of every element's text, and the elements in post-order."""
    down, after = _orders(root)
    out: dict[Node, Stats] = {}
    for n, linked in down:
        s = out[n] = Stats(elements=int(n.tag != "#document"))
        for c in n.children:
            if isinstance(c, str):
                k = content_chars(c)
                s.chars += k
                s.punct += punct_count(c)
                s.links += k if linked else 0
    for n in after:
        if n.parent is not None and n.parent in out:
            p, s = out[n.parent], out[n]
            p.chars += s.chars
            p.punct += s.punct
            p.links += s.links
            p.elements += s.elements
    return out, [n for n in after if n.tag != "#document"]


def block_score(s: Stats, o: Options) -> float:
    """Density of text, gated by punctuation, links and length."""
    if s.chars < 8:
        return 0.0
    gate = 1.0 if o.no_punct else min(s.punct / s.chars / 0.15, 1.0)
    links = 1.0 if o.no_link else 1 - s.link_rate
    return math.log1p(s.chars / (s.elements + 1)) * (0.2 + 0.8 * gate) * links * min(s.chars / 200, 1.0)


def pick_container(order: list[Node], stats: dict[Node, Stats], o: Options) -> tuple[Node | None, dict[Node, float]]:
    own = {n: block_score(stats[n], o) if n.tag in CANDIDATES else 0.0 for n in order}
    total: dict[Node, float] = {}
    best = None
    for n in order:
        total[n] = own[n]
        if not o.no_propagate:
            kids = [c for c in n.children if isinstance(c, Node)]
            total[n] += sum(own[c] for c in kids) + 0.5 * sum(own[g] for c in kids for g in c.children if isinstance(g, Node))
        if own[n] > 0 and (best is None or total[n] > total[best]):
            best = n
    if best is None:
        return None, total
    base, top = total[best], best.parent
    while top is not None and top.tag not in ("#document", "html", "body"):
        if total[top] < 0.75 * base or stats[top].link_rate > stats[best].link_rate + 0.10:
            break
        best, top = top, top.parent
    return best, total


def render(root: Node, stats: dict[Node, Stats]) -> tuple[str, int]:
    """The text of a container, with line ends between blocks, and its characters in links."""
    out: list[str] = []
    links = 0
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        n, linked = stack.pop()
        if isinstance(n, str):
            out.append(n)
            links += content_chars(n) if linked else 0
            continue
        if n.tag in BREAKS or n.tag in CANDIDATES:
            s = stats[n]
            if s.chars and s.link_rate > 0.5:
                continue
        linked = linked or n.tag == "a"
        if n.tag in BREAKS:
            out.append("\n")
            stack.append(("\n", False))
        stack += [(c, linked) for c in reversed(n.children)]
    return "".join(out), links


def metas(doc: Node, key: str) -> list[str]:
    out = []
    for n in doc.elements():
        if n.tag == "meta" and (n.attrs.get("property") or n.attrs.get("name", "")).lower() == key:
            v = n.attrs.get("content", "").strip(EDGES)
            if v:
                out.append(v)
    return out


def title_candidates(doc: Node, meta_title: str, json_title: str, known: Affixes) -> list[tuple[str, float]]:
    base = known.strip(meta_title)
    found = [(s, 1.0) for s in metas(doc, "og:title")] + [(s, 0.95) for s in metas(doc, "twitter:title")] + [(json_title, 0.9)]
    found += [(h.text(), 0.85 - 0.05 * i) for i, h in enumerate(doc.outermost("h1", 5))]
    found += [(s, 0.30 - 0.05 * i) for i, s in enumerate(title_segments(base))] + [(base, 0.25)]
    if fold(base) != fold(meta_title):
        found.append((meta_title, 0.1))
    return [(c, p) for c, p in ((collapse(s), p) for s, p in found) if c]


def title_score(text: str, prior: float, meta_title: str, head: str, known: Affixes) -> float:
    if not 4 <= len(text) <= 120:
        return -1.0
    s = prior + bigram_overlap(text, head) + 0.5 * affinity(text, meta_title) + 0.2 * length_fit(len(text))
    f = fold(text)
    return s - 1.5 * (bool(f) and f in (fold(known.prefix), fold(known.suffix)))


def real_title(doc: Node, content: str, meta_title: str, json_title: str, known: Affixes) -> str:
    best, top = "", 0.0
    for text, prior in title_candidates(doc, meta_title, json_title, known):
        s = title_score(text, prior, meta_title, content[:200], known)
        if s > top:
            best, top = text, s
    return best or known.strip(meta_title)


def is_article(container: str, link_rate: float, chars: int) -> bool:
    return container not in ("", "html", "body") and container not in NOT_PROSE and link_rate <= 0.5 and chars >= 80


def extract(html: str, known: Affixes = Affixes(), o: Options = Options()) -> dict:
    """All that is told of a page."""
    return extract_each(html, [(known, o)])[0]


def extract_each(html: str, ways: list[tuple[Affixes, Options]]) -> list[dict]:
    """All that is told of a page in each way; it is parsed and measured once, and each container read once."""
    doc = parse(html)
    scripts = (s for s in doc.outermost("script", 20) if "ld+json" in s.attrs.get("type", "").lower())
    json_title = next((h for h in (headline(s.text()) for s in scripts) if h), "")
    prune(doc)
    title = doc.first("title")
    meta_title = collapse(title.text()) if title else ""
    stats, order = text_stats(doc)
    body = stats.get(doc.first("body"), Stats())
    picked: dict[Options, Node | None] = {}
    read: dict[tuple, tuple[str, int, int]] = {}
    told: dict[tuple, dict] = {}

    def tell(container: Node | None, known: Affixes, keep_attribution: bool) -> dict:
        if (container, keep_attribution) not in read:
            raw, links = render(container, stats) if container else ("", 0)
            read[container, keep_attribution] = normalize(raw, keep_attribution), links, content_chars(raw)
        content, links, n = read[container, keep_attribution]
        real = real_title(doc, content, meta_title, json_title, known)
        content = drop_leading_title(content, real)
        chars, rate, tag = content_chars(content), links / n if n else 0.0, container.tag if container else ""
        good = is_article(tag, rate, chars)
        return {
            "meta_title": meta_title, "real_title": real, "main_content": content if good else "", "content_chars": chars if good else 0, "link_chars": links, "link_rate": rate,
            "page_chars": body.chars, "page_link_rate": body.link_rate, "container_tag": tag, "no_article": not good,
        }

    out = []
    for known, o in ways:
        if o not in picked:
            picked[o] = pick_container(order, stats, o)[0]
        way = picked[o], known, o.keep_attribution
        if way not in told:
            told[way] = tell(*way)
        out.append(told[way])
    return out
