"""Text measures as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.url import EDGE_SPACE, SPACE_CLASS

#: Six marks of ASCII, all other punctuation of Unicode, the wide tilde. Works in Java and RE2.
PUNCT = r"[,.!?;:～]|[^\x00-\x7F\P{P}]"
#: The narrower set that quality metrics use.
METRIC_PUNCT = r"[,.!?;:\x{3000}-\x{303f}\x{ff00}-\x{ff0f}\x{ff1a}-\x{ff1f}\x{2018}\x{2019}\x{201c}\x{201d}\x{2026}\x{2014}]"
#: ``SPACE_CLASS`` and ``METRIC_PUNCT`` for Java alone, laid out so that most characters need two look-ups instead of ten.
JAVA_SPACE = r"[[\t\n\x0b\f\r \x85\xa0][\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
JAVA_METRIC_PUNCT = r"[[,.!?;:][\x{2014}-\x{ff1f}&&[\x{3000}-\x{303f}\x{ff00}-\x{ff0f}\x{ff1a}-\x{ff1f}\x{2018}\x{2019}\x{201c}\x{201d}\x{2026}\x{2014}]]]"
TITLE_SPACE = r"[ \t\n\r\x{a0}\x{3000}]"
SEPARATOR = r"[|\-–—_/\\»«~]"
TITLE_EDGE = r"^[ \t\n\r\x{a0}\x{3000}|\-–—_/\\»«~]+|[ \t\n\r\x{a0}\x{3000}|\-–—_/\\»«~]+$"
#: All of them lie beyond U+10FF, which spares other characters the look-ups.
CJK = r"[\x{1100}-\x{10ffff}&&[\p{IsHan}\p{IsHiragana}\p{IsHangul}]]"
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def content_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), f"{JAVA_SPACE}+", ""))


def punct_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(PUNCT))


def metric_punct_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(JAVA_METRIC_PUNCT))


def cjk_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(CJK))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}+", " "))


def fold(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}|{PUNCT}", ""))


def bigram_overlap(a: Column, b: Column) -> Column:
    a, b = fold(a), fold(b)
    n = F.length(a)
    hits = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0), lambda s, i: s + F.contains(b, F.substring(a, i, F.lit(2))).cast("int"))
    return F.when(n == 0, 0.0).when(n == 1, F.contains(b, a).cast("double")).otherwise(hits / (n - 1))


def affinity(candidate: Column, title: Column) -> Column:
    c, t = fold(candidate), fold(title)
    return F.when((c == "") | (t == ""), 0.0).when(c == t, 0.5).when(F.startswith(t, c), 1.0).when(F.contains(t, c), 0.6).otherwise(0.0)


def length_fit(n: Column) -> Column:
    return F.when(n < 4, 0.0).when(n <= 60, 1.0).when(n <= 120, 0.5).otherwise(0.0)


def title_score(text: Column, prior: Column, title: Column, head: Column, prefix: Column, suffix: Column) -> Column:
    """How likely a candidate is a page's true title."""
    f = fold(text)
    chrome = (f != "") & ((f == fold(prefix)) | (f == fold(suffix)))
    s = prior + bigram_overlap(text, head) + 0.5 * affinity(text, title) + 0.2 * length_fit(F.length(text)) - F.when(chrome, 1.5).otherwise(0.0)
    return F.when(~F.length(text).between(4, 120), -1.0).otherwise(s)


def title_segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SEPARATOR), lambda s: F.regexp_replace(s, EDGE_SPACE, "")), lambda s: s != "")


def is_attribution(line: Column) -> Column:
    return (F.length(line) <= 120) & (F.contains(line, F.lit("://")) | F.contains(line, F.lit("www.")))


def normalize(c: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~is_attribution(x)), "\n")


def drop_leading_title(content: Column, title: Column) -> Column:
    """Without those of the first three lines that repeat the title."""
    lines, t = F.split(content, "\n"), fold(title)

    def step(s: Column, line: Column) -> Column:
        x, most = fold(line), 2 * F.length(t)
        close = (x == t) | (F.contains(t, x) & F.length(x).between(4, most)) | (F.contains(x, t) & (F.length(x) <= most + 8))
        on = s["on"] & ((x == "") | close)
        return F.struct(on.alias("on"), (s["n"] + on.cast("int")).alias("n"))

    n = F.aggregate(F.slice(lines, 1, 3), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when(t == "", content).otherwise(F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n"))


def strip_affixes(title: Column, prefix: Column, suffix: Column) -> Column:
    a = F.when((prefix != "") & F.startswith(title, prefix) & (F.length(title) > F.length(prefix)), F.substring(title, F.length(prefix) + 1, F.length(title))).otherwise(title)
    b = F.when((suffix != "") & F.endswith(a, suffix) & (F.length(a) > F.length(suffix)), F.substring(a, F.lit(1), F.length(a) - F.length(suffix))).otherwise(a)
    return F.regexp_replace(b, TITLE_EDGE, "")


def scan_title(html: Column) -> Column:
    """The first title of a page, from its source alone."""
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), TITLE_TAG, 1)
    return collapse(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, raw))


def visible_chars(html: Column) -> Column:
    """Characters outside of tags, scripts and styles, without spaces; for well-formed sources."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)\s*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "")
    return content_chars(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, t))


def digest(html: Column) -> Column:
    return F.substring(F.sha1(html), 1, 16)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def url_hash(u: Column) -> Column:
    """A 64-bit hash for placement only; identity goes by the string."""
    return F.xxhash64(u)
