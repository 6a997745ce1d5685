"""Queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text, url
from corpusloom.joins import spread
from corpusloom.operators import discover, extract, frontier, metrics, robots, sample, templates, titles
from corpusloom.storage import shared_dir
from corpusloom.streaming import pages as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- SQL twins of the Column functions


def _trim(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{url.EDGE_SPACE}', '', 'g')"


def _part(x: str, k: int) -> str:
    return f"regexp_extract({x}, '{url.PARTS}', {k})"


def _hostname(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({_part(x, 2)}, '{url.AUTHORITY}', 1)), '\.$', '')"


def _host_of(x: str) -> str:
    return f"lower(regexp_replace(coalesce({_part(x, 2)}, ''), '^.*@', ''))"


def _norm_cte(source: str, x: str, keep: str) -> str:
    """A CTE ``norm`` with keep, url_norm and host of web addresses, null for others."""
    return rf"""
parts AS (SELECT {keep}, u, lower({_part("u", 1)}) AS scheme, {_hostname("u")} AS h, regexp_extract({_part("u", 2)}, '{url.AUTHORITY}', 2) AS port, {_part("u", 3)} AS path, {_part("u", 4)} AS q
  FROM (SELECT {keep}, {_trim(x)} AS u FROM {source})),
keyed AS (SELECT *, CASE WHEN scheme IN ('http', 'https') AND h <> '' THEN h || CASE WHEN port = '' OR scheme = 'http' AND port = '80' OR scheme = 'https' AND port = '443' THEN '' ELSE ':' || port END END AS host FROM parts),
norm AS (SELECT {keep}, host, scheme || '://' || host || path || CASE WHEN contains(regexp_replace(u, '#.*$', ''), '?') THEN '?' || q ELSE '' END AS url_norm FROM keyed)"""


def _segs(x: str) -> str:
    return f"list_filter(string_split(lower({_part(x, 3)}), '/'), lambda s: s <> '')"


_FUNCTIONAL = "[" + ", ".join(f"'{w}'" for w in url.FUNCTIONAL) + "]"


def _functional(x: str) -> str:
    return f"list_has_any({_segs(x)}, {_FUNCTIONAL})"


def _numeric(x: str) -> str:
    return f"len(list_filter(string_split({_part(x, 4)}, '&'), lambda kv: regexp_matches(regexp_replace(regexp_extract(kv, '^[^=]*=(.*)$', 1), '{url.EDGE_SPACE}', '', 'g'), '^[0-9]{{2,18}}$'))) > 0"


def _article(x: str) -> str:
    last = rf"regexp_replace(regexp_replace(regexp_replace(coalesce({_segs(x)}[-1], ''), '\.html$', ''), '\.htm$', ''), '\.shtml$', '')"
    bad = f"regexp_matches(lower({_part(x, 3)}), '{url.FILE_END}') OR {_functional(x)} OR len(list_filter({_segs(x)}, lambda s: starts_with(s, 'page') OR starts_with(s, 'p_'))) > 0"
    deep = f"len({_segs(x)}) >= 2 AND (regexp_matches({last}, '[0-9]') OR length({last}) >= 8 OR len(list_filter({_segs(x)}, lambda s: octet_length(encode(s)) = 4 AND regexp_matches(s, '[0-9]'))) > 0)"
    return f"(NOT ({bad}) AND ({deep} OR {_numeric(x)}))"


def _inner(x: str) -> str:
    return f"regexp_replace({_part(x, 3)}, '^/+|/+$', '', 'g')"


def _rank(x: str) -> str:
    last = f"string_split({_inner(x)}, '/')[-1]"
    return (
        rf"(CASE WHEN regexp_matches({last}, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN length({last}) BETWEEN 6 AND 60 THEN 2 ELSE 0 END + len(string_split({_inner(x)}, '/'))"
        rf" + CASE WHEN regexp_matches({last}, '\.(s?html|htm)$') THEN 1 ELSE 0 END + CASE WHEN {_part(x, 4)} <> '' THEN 1 ELSE 0 END + CASE WHEN contains({_inner(x)}, '/20') THEN 1 ELSE 0 END)::INT"
    )


def _fold(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace(coalesce({x}, ''), '{url.SPACE_CLASS}', '', 'g'), '{text.PUNCT}', '', 'g'))"


def _collapse(x: str) -> str:
    return f"regexp_replace({_trim(x)}, '{url.SPACE_CLASS}+', ' ', 'g')"


def _chars(x: str) -> str:
    return f"length(regexp_replace(coalesce({x}, ''), '{url.SPACE_CLASS}', '', 'g'))"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{pattern}'))"


def _entities(x: str) -> str:
    for a, b in text.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def _title(x: str) -> str:
    return _collapse(_entities(f"regexp_extract(coalesce({x}, ''), '{text.TITLE_TAG}', 1)"))


_BLOCKED = " OR ".join(f"h = '{b}' OR h LIKE '%.{b}'" for b in url.BLOCKED)


# --- addresses


@query(f"SELECT {_host_of('url')} AS host, count(*) AS pages FROM pages GROUP BY 1")
def host_page_counts(spark, d):
    return table(spark, d, "pages").groupBy(url.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query(f"WITH {_norm_cte('pages', 'url', 'page_id')} SELECT page_id, url_norm, host FROM norm")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", url.normalize(F.col("url")).alias("url_norm"), url.host_key(url.trim(F.col("url"))).alias("host"))


_ODD = [
    "HTTP://Example.COM:80/a?x=1#f", "https://example.com.:443/", "https://example.com:8443/A", "http://[2001:db8::1]:80/x", "ftp://example.com/", "//example.com/a", "example.com", "  http://a.b/?q#z ", "mailto:x@y.z", "http://user:pw@c.d:81/p",
    "", "http://例え.テスト/路", "http://a.b?x", "https://a.b:80/", "# remark", "www.zhihu.com", "https://m.weibo.com:443/x", "sub.domain.org:8080", "localhost", "http://x.com", "notx.com", "HTTPS://News.Example.ORG./y",
]
_ODD_SQL = "(VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(_ODD)) + ") AS odd(i, u0)"


def _odd(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_ODD)), "i int, u0 string")


@query(f"WITH {_norm_cte(_ODD_SQL, 'u0', 'i')} SELECT i, url_norm, host FROM norm")
def url_normalize_odd(spark, d):
    return _odd(spark).select("i", url.normalize(F.col("u0")).alias("url_norm"), url.host_key(url.trim(F.col("u0"))).alias("host"))


@query(f"WITH {_norm_cte('pages', 'url', 'page_id')} SELECT url_norm, min(host) AS host, min(page_id) AS page_id FROM norm WHERE url_norm IS NOT NULL GROUP BY url_norm")
def dedupe_norm_url(spark, d):
    return frontier.dedupe(table(spark, d, "pages"))


@query(f"""
WITH raw AS (SELECT url AS r FROM pages UNION ALL SELECT u0 FROM {_ODD_SQL}), t AS (SELECT {_trim("r")} AS t FROM raw),
u AS (SELECT t, CASE WHEN contains(t, '://') THEN t ELSE 'http://' || t END AS u FROM t), h AS (SELECT t, u, {_hostname("u")} AS h FROM u)
SELECT DISTINCT h AS host FROM h WHERE t <> '' AND NOT starts_with(t, '#') AND lower({_part("u", 1)}) IN ('http', 'https') AND contains(h, '.') AND NOT ({_BLOCKED})""")
def seed_hosts(spark, d):
    raw = table(spark, d, "pages").select("url").union(_odd(spark).select("u0"))
    return raw.select(url.seed_host(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()


@query(f"SELECT h AS host, {_BLOCKED} AS blocked FROM (SELECT DISTINCT {_hostname('url')} AS h FROM pages UNION SELECT unnest(['a.qq.com', 'qq.com', 'notqq.com', 'xx.com', 'x.com', 'so.com.cn']))")
def blocked_hosts(spark, d):
    own = spark.createDataFrame([(h,) for h in ("a.qq.com", "qq.com", "notqq.com", "xx.com", "x.com", "so.com.cn")], "host string")
    hosts = table(spark, d, "pages").select(url.hostname(F.col("url")).alias("host")).union(own).distinct()
    return hosts.select("host", url.is_blocked(F.col("host")).alias("blocked"))


_SHAPES = [
    "http://a.b/news/2024/01/15/slug", "http://a.b/a/12345.html", "http://a.b/show.php?aid=123", "http://a.b/login/2024/x1", "http://a.b/x/y/file.exe", "http://a.b/list/page2/abc12345", "http://a.b/", "http://a.b/about/longsegment",
    "http://a.b/c/p_2/item99", "http://a.b/s/abc?id=1", "http://a.b/s/abcdefgh.htm", "http://a.b/q?id=1&n= 22 ", "http://a.b/d/2x24/ab", "http://a.b/文章/一二三四五六七八", "http://a.b/x/photo.JPG", "http://a.b//x//y1.shtml",
]
_SHAPES_SQL = "(SELECT url FROM pages UNION ALL SELECT unnest([" + ", ".join(f"'{u}'" for u in _SHAPES) + "]))"


def _shapes(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("url").union(spark.createDataFrame([(u,) for u in _SHAPES], "url string"))


@query(f"SELECT url, {_functional('url')} AS functional, {_article('url')} AS article_like, {_numeric('url')} AS numeric_param, {_rank('url')} AS score, (length({_inner('url')}) - length(replace({_inner('url')}, '/', '')))::INT AS depth FROM {_SHAPES_SQL}")
def url_shapes(spark, d):
    u = F.col("url")
    return _shapes(spark, d).select("url", url.is_functional(u).alias("functional"), url.looks_like_article(u).alias("article_like"), url.has_numeric_param(u).alias("numeric_param"), url.rank(u).alias("score"), url.depth(u).alias("depth"))


@query(f"""
WITH s AS (SELECT page_id, url, {_host_of("url")} AS host, {_rank("url")} AS score FROM pages WHERE {_article("url")}),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS rank FROM s) SELECT host, page_id, url, score, rank FROM r WHERE rank <= 3""")
def top_articles_per_host(spark, d):
    links = table(spark, d, "pages").select("page_id", "url", url.host_of(F.col("url")).alias("host"))
    return discover.pick_articles(links, 3, order="page_id").select("host", "page_id", "url", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""
WITH s AS (SELECT {_host_of("url")} AS host, url, min(page_id) AS page_id FROM pages WHERE NOT {_functional("url")} AND {_inner("url")} <> '' GROUP BY 1, 2),
r AS (SELECT *, length({_inner("url")}) - length(replace({_inner("url")}, '/', '')) AS depth FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY depth, page_id) AS rank FROM r)
SELECT host, url, page_id, depth::INT AS depth, rank FROM k WHERE rank <= 2""")
def sections_per_host(spark, d):
    links = table(spark, d, "pages").select("page_id", "url", url.host_of(F.col("url")).alias("host"))
    return discover.pick_sections(links, 2, order="page_id").select("host", "url", "page_id", "depth", F.col("rank").cast("bigint").alias("rank"))


@query(r"""
SELECT page_id, (unnest(range(1, len(f) + 1)) - 1)::INT AS pos, unnest(f) AS href
FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href="([^"#][^"]*)"', 1) AS f FROM pages)""")
def source_links(spark, d):
    return discover.source_links(table(spark, d, "pages"))


@query()
def page_links(spark, d):
    found = discover.links(table(spark, d, "pages"))
    return found.withColumn("score", url.rank(F.col("link")))


@query()
def harvested_hosts(spark, d):
    pages = table(spark, d, "pages").withColumn("html", F.concat("html", F.lit('<a href="http://other.example/x">o</a><a href="https://www.qq.com/">q</a><a href="//third.example:81/">t</a>')))
    return discover.harvest_hosts(pages)


# --- titles


@query(f"SELECT page_id, {_title('html')} AS title FROM pages")
def scan_title(spark, d):
    return table(spark, d, "pages").select("page_id", text.scan_title(F.col("html")).alias("title"))


_LONG_TITLE = "'Section | ' || {t} || ' - ' || {h}"


@query(f"WITH t AS (SELECT page_id, {_LONG_TITLE.format(t=_title('html'), h=_host_of('url'))} AS title FROM pages) SELECT page_id, list_filter([regexp_replace(x, '{url.EDGE_SPACE}', '', 'g') FOR x IN regexp_split_to_array(title, '{text.SEPARATOR}')], lambda s: s <> '') AS segments FROM t")
def title_segments(spark, d):
    t = F.concat(F.lit("Section | "), text.scan_title(F.col("html")), F.lit(" - "), url.host_of(F.col("url")))
    return table(spark, d, "pages").select("page_id", text.title_segments(t).alias("segments"))


_H1 = r"(?is)<h1[^>]*>(.*?)</h1"


@query(f"""
WITH t AS (SELECT page_id, {_title("html")} AS t, {_collapse(f"regexp_extract(html, '{_H1}', 1)")} AS h FROM pages), f AS (SELECT page_id, {_fold("h")} AS c, {_fold("t")} AS m, h, t FROM t)
SELECT page_id, (CASE WHEN c = '' OR m = '' THEN 0.0 WHEN c = m THEN 0.5 WHEN starts_with(m, c) THEN 1.0 WHEN contains(m, c) THEN 0.6 ELSE 0.0 END)::DOUBLE AS affinity,
  (CASE WHEN length(h) < 4 THEN 0.0 WHEN length(h) <= 60 THEN 1.0 WHEN length(h) <= 120 THEN 0.5 ELSE 0.0 END)::DOUBLE AS fit,
  round(CASE WHEN length(c) = 0 THEN 0.0 WHEN length(c) = 1 THEN contains(m, c)::INT ELSE len(list_filter(range(1, length(c)), lambda i: contains(m, substring(c, i, 2)))) / (length(c) - 1)::DOUBLE END, 6) AS overlap FROM f""")
def title_match(spark, d):
    h = text.collapse(F.regexp_extract("html", _H1, 1))
    t = text.scan_title(F.col("html"))
    return table(spark, d, "pages").select("page_id", text.affinity(h, t).alias("affinity"), text.length_fit(F.length(h)).alias("fit"), F.round(text.bigram_overlap(h, t), 6).alias("overlap"))


def _learn_sql(title: str) -> str:
    checkpoints = ", ".join(map(str, titles.CHECKPOINTS))
    cut = f"(?:{text.SEPARATOR}|{text.TITLE_SPACE})"
    return f"""
t AS (SELECT page_id, {_host_of("url")} AS host, {title} AS title FROM pages),
s AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r, count(*) OVER (PARTITION BY host) AS n FROM t WHERE host <> '' AND title <> ''),
m AS (SELECT *, list_max(list_filter([{checkpoints}], lambda c: c <= n)) AS m FROM s), k AS (SELECT *, floor(min(length(title)) OVER (PARTITION BY host) * 0.7)::INT AS lim FROM m WHERE r <= m),
e AS (SELECT host, m, lim, 'prefix' AS e, title AS x FROM k UNION ALL SELECT host, m, lim, 'suffix', reverse(title) FROM k),
c AS (SELECT host, m, e, pos, substring(x, pos::INT, 1) AS ch FROM (SELECT host, m, e, x, unnest(range(1, lim + 1)) AS pos FROM e)),
v AS (SELECT host, e, pos, ch FROM c GROUP BY host, m, e, pos, ch HAVING count(*) >= ceil(0.6 * m)),
g AS (SELECT host, e, pos, ch FROM (SELECT *, row_number() OVER (PARTITION BY host, e ORDER BY pos) AS k FROM v) WHERE k = pos),
a AS (SELECT host, e, string_agg(ch, '' ORDER BY pos) AS x FROM g GROUP BY host, e),
f AS (SELECT host, coalesce(max(CASE WHEN e = 'prefix' THEN regexp_extract(x, '(?s)^(.*{cut})', 1) END), '') AS p, coalesce(max(CASE WHEN e = 'suffix' THEN regexp_extract(reverse(x), '(?s)({cut}.*)$', 1) END), '') AS q FROM a GROUP BY host),
learned AS (SELECT h.host, h.m AS pages, CASE WHEN length(p) >= 2 THEN p ELSE '' END AS prefix, CASE WHEN length(q) >= 2 THEN q ELSE '' END AS suffix FROM (SELECT host, max(m) AS m FROM k GROUP BY host) h LEFT JOIN f USING (host))"""


def _long_titles(spark, d) -> DataFrame:
    host = url.host_of(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.concat(F.lit("Section | "), text.scan_title(F.col("html")), F.lit(" - "), host).alias("title"))


@query(f"WITH {_learn_sql(_title('html'))} SELECT host, pages::INT AS pages, prefix, suffix FROM learned WHERE pages IS NOT NULL")
def learn_affixes_plain(spark, d):
    return titles.learn_affixes(metrics.with_titles(table(spark, d, "pages")))


@query(f"WITH {_learn_sql(_LONG_TITLE.format(t=_title('html'), h=_host_of('url')))} SELECT host, pages::INT AS pages, prefix, suffix FROM learned WHERE pages IS NOT NULL")
def learn_affixes(spark, d):
    return titles.learn_affixes(_long_titles(spark, d))


@query(f"""
WITH {_learn_sql(_LONG_TITLE.format(t=_title("html"), h=_host_of("url")))},
j AS (SELECT t.page_id, t.title, coalesce(prefix, '') AS p, coalesce(suffix, '') AS q FROM t LEFT JOIN learned USING (host)),
x AS (SELECT *, CASE WHEN p <> '' AND starts_with(title, p) AND length(title) > length(p) THEN substring(title, length(p) + 1) ELSE title END AS a FROM j)
SELECT page_id, title, regexp_replace(CASE WHEN q <> '' AND ends_with(a, q) AND length(a) > length(q) THEN left(a, length(a) - length(q)) ELSE a END, '{text.TITLE_EDGE}', '', 'g') AS stripped FROM x""")
def strip_affixes(spark, d):
    known = titles.learn_affixes(_long_titles(spark, d))
    joined = _long_titles(spark, d).join(known, "host", "left")
    return joined.select("page_id", "title", text.strip_affixes(F.col("title"), F.coalesce("prefix", F.lit("")), F.coalesce("suffix", F.lit(""))).alias("stripped"))


# --- texts

_BLANK = r"\s"


@query(f"""
SELECT doc_id, {_chars("text")}::INT AS chars, {_count("text", text.PUNCT)}::INT AS punct, {_count("text", text.METRIC_PUNCT)}::INT AS metric_punct,
  {_count("text", "[" + chr(92) + "p{Han}" + chr(92) + "p{Hiragana}" + chr(92) + "p{Hangul}]")}::INT AS cjk, md5({_fold("text")}) AS folded, md5({_collapse("text")}) AS collapsed, substring(sha1(coalesce(text, '')), 1, 16) AS digest FROM documents""")
def text_profile(spark, d):
    t = F.col("text")
    return spread(table(spark, d, "documents"), "doc_id").select(
        "doc_id", text.content_chars(t).alias("chars"), text.punct_count(t).alias("punct"), text.metric_punct_count(t).alias("metric_punct"), text.cjk_count(t).alias("cjk"), F.md5(text.fold(t)).alias("folded"),
        F.md5(text.collapse(t)).alias("collapsed"), text.digest(F.coalesce(t, F.lit(""))).alias("digest"),
    )


def _lines_sql(x: str) -> str:
    return f"[{_collapse('y')} FOR y IN string_split(coalesce({x}, ''), chr(10))]"


@query(f"""
WITH d AS (SELECT doc_id, text || chr(10) || 'from http://a.b' || chr(10) || '   ' || chr(10) || 'end  of text' AS t FROM documents)
SELECT doc_id, array_to_string(list_filter({_lines_sql("t")}, lambda s: s <> '' AND NOT (length(s) <= 120 AND (contains(s, '://') OR contains(s, 'www.')))), chr(10)) AS normalized FROM d""")
def normalize_text(spark, d):
    t = F.concat("text", F.lit("\nfrom http://a.b\n   \nend  of text"))
    return table(spark, d, "documents").select("doc_id", text.normalize(t).alias("normalized"))


def _repeat_sql(i: int) -> str:
    x = _fold(f"l[{i}]")
    return f"(len(l) >= {i} AND ({x} = '' OR {x} = t OR (contains(t, {x}) AND length({x}) >= 4 AND length({x}) <= 2 * length(t)) OR (contains({x}, t) AND length({x}) <= 2 * length(t) + 8)))"


@query(f"""
WITH d AS (SELECT doc_id, text AS c, substring(coalesce(text, ''), 1, 30) AS h FROM documents), s AS (SELECT doc_id, h || chr(10) || ' ' || chr(10) || c AS c, {_fold("h")} AS t FROM d), x AS (SELECT *, string_split(c, chr(10)) AS l FROM s),
n AS (SELECT *, CASE WHEN {_repeat_sql(1)} THEN CASE WHEN {_repeat_sql(2)} THEN CASE WHEN {_repeat_sql(3)} THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END AS n FROM x)
SELECT doc_id, CASE WHEN t = '' THEN c ELSE array_to_string(l[n + 1:], chr(10)) END AS body FROM n""")
def drop_leading_title(spark, d):
    h = F.substring(F.coalesce("text", F.lit("")), 1, 30)
    return table(spark, d, "documents").select("doc_id", text.drop_leading_title(F.concat(h, F.lit("\n \n"), F.col("text")), h).alias("body"))


@query(rf"""
SELECT page_id, {_chars(_entities(f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript){_BLANK}*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')"))}::INT AS visible_chars,
  substring(sha1(html), 1, 16) AS digest FROM pages""")
def visible_chars(spark, d):
    return table(spark, d, "pages").select("page_id", text.visible_chars(F.col("html")).alias("visible_chars"), text.digest(F.col("html")).alias("digest"))


# --- templates

_GRAMS_SQL = f"""
p AS (SELECT doc_id, source AS host, regexp_replace(coalesce(text, ''), '{text.TITLE_SPACE}', '', 'g') AS t FROM documents), q AS (SELECT * FROM p WHERE length(t) >= 5),
hosts AS (SELECT host, greatest(2, ceil(0.5 * count(*))) AS need FROM q GROUP BY host HAVING count(*) >= 3),
df AS (SELECT host, gram, count(*) AS n FROM (SELECT DISTINCT doc_id, host, substring(t, i::INT, 5) AS gram FROM (SELECT doc_id, host, t, unnest(range(1, length(t) - 3)) AS i FROM q)) GROUP BY host, gram),
grams AS (SELECT df.host, gram FROM df JOIN hosts USING (host) WHERE n >= need)"""

@query(f"WITH {_GRAMS_SQL} SELECT host, gram FROM grams")
def template_grams(spark, d):
    return templates.learn_templates(table(spark, d, "documents"), key="doc_id")


_CUT_SQL = f"""
{_GRAMS_SQL}, l AS (SELECT doc_id, source AS host, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS s FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
h AS (SELECT g.* FROM (SELECT doc_id, host, line, i, substring(s, i::INT, 5) AS gram FROM (SELECT *, unnest(range(1, length(s) - 3)) AS i FROM l WHERE length(s) >= 5)) g SEMI JOIN grams ON grams.host = g.host AND grams.gram = g.gram),
r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, line ORDER BY i) AS run FROM (SELECT doc_id, line, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, line ORDER BY i) <= 5 THEN 0 ELSE 1 END AS b FROM h)),
c AS (SELECT doc_id, line, min(i) AS a, max(i) + 5 AS z FROM r GROUP BY doc_id, line, run HAVING max(i) + 5 - min(i) >= 8),
g AS (SELECT doc_id, line, list(i) AS gone FROM (SELECT doc_id, line, unnest(range(a, z)) AS i FROM c) GROUP BY 1, 2),
k AS (SELECT l.doc_id, l.line, regexp_replace(CASE WHEN gone IS NULL THEN s ELSE array_to_string([x FOR x, i IN string_split(s, '') IF NOT list_contains(gone, i)], '') END, '{url.EDGE_SPACE}', '', 'g') AS s FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line),
w AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS cut FROM k GROUP BY doc_id),
stripped AS (SELECT d.doc_id, d.source, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' OR NOT EXISTS (SELECT 1 FROM grams WHERE grams.host = d.source) OR {_chars("cut")} * 2 < {_chars("text")} THEN coalesce(text, '') ELSE cut END AS stripped
  FROM documents d JOIN w ON w.doc_id = d.doc_id)"""


@query(f"WITH {_CUT_SQL} SELECT doc_id, source, stripped FROM stripped")
def template_strip(spark, d):
    docs = table(spark, d, "documents")
    return templates.strip_templates(docs, templates.learn_templates(docs, key="doc_id"))


@query(f"WITH {_CUT_SQL}, n AS (SELECT sum({_chars('text')}) AS b, sum({_chars('stripped')}) AS a FROM stripped WHERE source IN (SELECT host FROM grams)) SELECT (b - a)::BIGINT AS cut_chars, b::BIGINT AS chars, round((b - a) / b, 6) AS residue FROM n")
def template_residue(spark, d):
    return templates.residue(table(spark, d, "documents")).withColumn("residue", F.round("residue", 6))


# --- scheduling, over events: a user stands for a host, an error for a failed fetch, a purchase for an article


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events)
SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE us / 1e6 < 3600 - 1e-5) AS violations, round(min(us) / 1e6, 6) AS min_gap_s FROM g GROUP BY user_id""")
def politeness_violations(spark, d):
    out = frontier.violations(table(spark, d, "events"), "user_id", "ts", "event_id", 3600.0)
    return out.withColumn("min_gap_s", F.round("min_gap_s", 6))


@query("SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 6) AS gap_s FROM events")
def politeness_gaps(spark, d):
    return frontier.gaps(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", F.round("gap_s", 6).alias("gap_s"))


@query("""
WITH h AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM events) SELECT event_id, user_id FROM h WHERE h < 5""")
def stop_at_target(spark, d):
    return frontier.until_target(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 5).select("event_id", "user_id")


_STREAK_SQL = """
r AS (SELECT event_id, user_id, ts, (event_type = 'error')::INT AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r)"""


@query(f"WITH {_STREAK_SQL} SELECT event_id, user_id, streak::BIGINT AS streak FROM s")
def failure_streaks(spark, d):
    return frontier.failure_streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "streak")


@query(f"WITH {_STREAK_SQL}, a AS (SELECT user_id, min((ts, event_id)) AS at FROM s WHERE streak >= 2 GROUP BY user_id) SELECT e.event_id, e.user_id FROM events e LEFT JOIN a USING (user_id) WHERE a.at IS NULL OR (e.ts, e.event_id) <= a.at")
def before_abandoning(spark, d):
    return frontier.before_abandoning(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "user_id")


_QUEUE_SQL = f"""{_norm_cte("pages", "url", "page_id")},
u AS (SELECT url_norm, min(host) AS host, min(page_id) AS page_id FROM norm WHERE url_norm IS NOT NULL GROUP BY url_norm), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS place FROM u),
s AS (SELECT *, (place - 1) * CASE WHEN host LIKE '%a%' THEN 4.0 ELSE 1.5 END AS start_s FROM k WHERE place <= 5)"""


def _scheduled(spark, d) -> DataFrame:
    queued = frontier.queue(table(spark, d, "pages"), 5)
    slow = queued.select("host").distinct().select("host", F.when(F.col("host").like("%a%"), 4.0).otherwise(0.5).alias("delay"))
    return frontier.schedule(queued, 1.5, slow)


@query(f"WITH {_QUEUE_SQL} SELECT url_norm, host, page_id, place, round(start_s, 6)::DOUBLE AS start_s FROM s")
def schedule_plan(spark, d):
    return _scheduled(spark, d).select("url_norm", "host", "page_id", F.col("place").cast("bigint").alias("place"), F.round("start_s", 6).alias("start_s"))


@query(f"WITH {_QUEUE_SQL}, t AS (SELECT *, CASE WHEN start_s > 5 THEN 'queued' WHEN start_s > 3 THEN 'busy' ELSE 'done' END AS state FROM s) SELECT state, count(*) AS requests, count(DISTINCT host) AS hosts FROM t GROUP BY state")
def queue_stats(spark, d):
    return frontier.queue_stats(_scheduled(spark, d), 5.0, 2.0)


@query(f"WITH {_QUEUE_SQL} SELECT round(min(start_s) - 2, 6)::DOUBLE AS wait_s FROM s WHERE start_s >= 2")
def next_wait(spark, d):
    return frontier.next_wait(_scheduled(spark, d), 2.0).select(F.round("wait_s", 6).alias("wait_s"))


@query("""
SELECT count(*) AS pages, count(DISTINCT user_id) AS hosts, count(*) FILTER (WHERE event_type = 'purchase') AS articles, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS empty,
  sum(CASE WHEN event_type <> 'error' THEN octet_length(encode(props)) END)::BIGINT AS bytes, round(count(*) FILTER (WHERE event_type = 'purchase') / count(*), 6) AS article_share FROM events""")
def crawl_report(spark, d):
    t = F.col("event_type")
    out = frontier.crawl_report(table(spark, d, "events"), "user_id", t == "error", t == "purchase", t == "view", F.octet_length("props"))
    return out.withColumn("article_share", F.round("article_share", 6))


@query(f"WITH {_norm_cte('pages', 'url', 'page_id')}, t AS (SELECT url_norm AS url, min(page_id) AS page_id FROM norm WHERE url_norm IS NOT NULL GROUP BY 1), done AS (SELECT url FROM t WHERE page_id % 3 = 0) SELECT url, page_id FROM t ANTI JOIN done USING (url)")
def not_done(spark, d):
    tasks = frontier.dedupe(table(spark, d, "pages")).select(F.col("url_norm").alias("url"), "page_id")
    return frontier.not_done(tasks, tasks.filter("page_id % 3 = 0"))


@query("SELECT (SELECT count(DISTINCT url) FROM pages) AS handled, (SELECT count(DISTINCT url) FROM pages WHERE octet_length(encode(html)) > 1000) AS saved, (SELECT count(DISTINCT url) FROM pages WHERE octet_length(encode(html)) > 1000) >= 0.98 * (SELECT count(DISTINCT url) FROM pages) AS persisted")
def persistence_check(spark, d):
    pages = table(spark, d, "pages")
    return frontier.persistence_check(pages, pages.filter(F.octet_length("html") > 1000))


@query("""
WITH x AS (SELECT page_id, url, html || '' AS c FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id + 100000, url, 'again' FROM pages WHERE page_id % 10 = 0),
l AS (SELECT url, max_by(c, page_id) AS c FROM x GROUP BY url) SELECT p.page_id, p.url, coalesce(l.c, '') AS result FROM pages p LEFT JOIN l USING (url)""")
def align_external(spark, d):
    from corpusloom.sources.tables import align

    pages = table(spark, d, "pages")
    ext = pages.filter("page_id % 2 = 0").select("page_id", "url", F.col("html").alias("result")).union(pages.filter("page_id % 10 = 0").select(F.col("page_id") + 100000, "url", F.lit("again")))
    return align(pages.select("page_id", "url"), ext, "url", "page_id", ["result"])


# --- robots

_ROBOTS = [
    ("*", False, "/en/"), ("*", True, "/en/8"), ("*", False, "/archive"), ("*", True, "/archive/"), ("*", False, "/a"), ("*", True, "/a"), ("*", False, ""), ("*", False, "/news/1"), ("*", False, "/posts"),
]
_ROBOTS_TEXT = "User-agent: badbot\nDisallow: /\n\nUser-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}  # rule" for _, a, p in _ROBOTS) + "\nCrawl-delay: 2\n"
_ROBOTS_SQL = "(VALUES " + ", ".join(f"({str(a).lower()}, '{p}')" for _, a, p in _ROBOTS if p) + ") AS r(allow, prefix)"


def _decided(spark, d) -> DataFrame:
    pages = table(spark, d, "pages")
    hosts = pages.select(url.host_of(F.col("url")).alias("host")).distinct()
    slow = F.when(F.col("host").like("%b%"), F.lit("User-agent: *\nCrawl-delay: 3600")).when(F.col("host").like("%c%"), F.lit("User-agent: badbot\nDisallow: /")).otherwise(_ROBOTS_TEXT)
    return robots.decide(pages.select("page_id", "url"), robots.robots_rules(hosts.select("host", slow.alias("text"))), "loom/1.0")


_DECIDED_SQL = f"""
p AS (SELECT page_id, {_host_of("url")} AS host, CASE WHEN {_part("url", 3)} = '' THEN '/' ELSE {_part("url", 3)} END AS path FROM pages),
b AS (SELECT page_id, max_by(allow, length(prefix) * 2 + allow::INT) AS allow FROM p JOIN {_ROBOTS_SQL} ON starts_with(p.path, r.prefix) GROUP BY page_id),
dec AS (SELECT page_id, host, CASE WHEN host LIKE '%b%' THEN 3600.0 WHEN host LIKE '%c%' THEN 0.0 ELSE 2.0 END AS delay_s, CASE WHEN host LIKE '%b%' THEN 'delay' WHEN host LIKE '%c%' THEN NULL WHEN NOT coalesce(allow, true) THEN 'robots' END AS reason FROM p LEFT JOIN b USING (page_id))"""


@query(f"WITH {_DECIDED_SQL} SELECT page_id, host, delay_s::DOUBLE AS delay_s, reason FROM dec")
def robots_decisions(spark, d):
    return _decided(spark, d).select("page_id", "host", "delay_s", "reason")


@query(f"WITH {_DECIDED_SQL} SELECT coalesce(reason, 'allowed') AS reason, count(*) AS urls, count(DISTINCT host) AS hosts FROM dec GROUP BY 1")
def robots_report(spark, d):
    return robots.skip_report(_decided(spark, d))


# --- samples


@query("WITH p AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS p, count(*) OVER () AS n FROM pages) SELECT page_id, url FROM p WHERE p IN (SELECT (i * (SELECT count(*) FROM pages)) // 30 FROM range(30) t(i))")
def every_nth(spark, d):
    return sample.every_nth(table(spark, d, "pages").select("page_id", "url"), ["page_id"], 30)


_STRATA_SQL = """
m AS (SELECT doc_id, source, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT * FROM m WHERE n <= 7 OR list_contains([round_even(i * (n - 1) / 6.0, 0)::BIGINT FOR i IN range(7)], p))"""


@query(f"WITH {_STRATA_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS q, count(*) OVER () AS c FROM s) SELECT doc_id, source FROM t WHERE c <= 50 OR list_contains([round_even(i * (c - 1) / 49.0, 0)::BIGINT FOR i IN range(50)], q)")
def stratified_sample(spark, d):
    return sample.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 7, 50)


@query("""
WITH c AS (SELECT source, length(coalesce(text, '')) AS c FROM documents), s AS (SELECT list(c ORDER BY c) AS l, count(*) AS n FROM c)
SELECT n AS rows, (SELECT count(DISTINCT source) FROM c) AS hosts, round((SELECT count(*) FROM c WHERE c = 0) / n, 6) AS empty_share, l[1]::INT AS min_chars, l[least(n - 1, floor(0.25 * n)::BIGINT) + 1]::INT AS p25, l[least(n - 1, floor(0.5 * n)::BIGINT) + 1]::INT AS median,
  l[least(n - 1, floor(0.75 * n)::BIGINT) + 1]::INT AS p75, l[n]::INT AS max_chars, round((SELECT count(*) FROM c WHERE c >= 300) / n, 6) AS long_share FROM s""")
def sample_report(spark, d):
    out = sample.report(table(spark, d, "documents"), "source", F.length(F.coalesce("text", F.lit(""))))
    return out.withColumns({"empty_share": F.round("empty_share", 6), "long_share": F.round("long_share", 6)})


# --- extraction: no parser in SQL; tests hold these against fixtures


@query()
def extract_pages(spark, d):
    pages = table(spark, d, "pages")
    return extract.is_article(extract.extract_pages(pages, titles.learn_affixes(metrics.with_titles(pages))))


@query()
def extract_report(spark, d):
    return metrics.extract_stats(extract.extract_pages(table(spark, d, "pages")))


@query()
def dom_nodes(spark, d):
    return extract.dom_nodes(table(spark, d, "pages"))


@query()
def containers_by_joins(spark, d):
    return extract.containers(extract.dom_nodes(table(spark, d, "pages")))


@query()
def ablation(spark, d):
    return metrics.ablation(table(spark, d, "pages"))


@query(f"SELECT doc_id, quality = 1 AND {_chars('text')} >= 300 AS accepted FROM documents JOIN labels USING (doc_id)")
def accepted_documents(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", ((F.col("quality") == 1) & (text.content_chars(F.col("text")) >= 300)).alias("accepted"))


@query()
def build_corpus(spark, d):
    from corpusloom.plans.corpus import build_corpus as build

    return build(table(spark, d, "pages"))


@query()
def crawl_replay(spark, d):
    from corpusloom.plans.corpus import replay

    return replay(table(spark, d, "pages"))


# --- streams: each runs over all that is there and ends


def _finish(started) -> None:
    started.awaitTermination()


def _work(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query()
def stream_extract(spark, d):
    at = _work(spark, "stream-extract")
    _finish(stream.extract_by_batch(stream.read_stream(spark, f"{d}/pages.parquet"), f"{at}/titles", f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").drop("batch")


@query()
def stream_extract_online(spark, d):
    at = _work(spark, "stream-online")
    out = stream.extract_online(stream.read_stream(spark, f"{d}/pages.parquet"))
    _finish(out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out"))
    return spark.read.parquet(f"{at}/out")


@query(f"WITH {_norm_cte('pages', 'url', 'page_id')} SELECT url_norm, min(host) AS host FROM norm WHERE url_norm IS NOT NULL GROUP BY url_norm")
def stream_first_seen(spark, d):
    at = _work(spark, "stream-seen")
    out = stream.first_seen(stream.read_stream(spark, f"{d}/pages.parquet"))
    _finish(out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out"))
    return spark.read.parquet(f"{at}/out")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS begin_s, user_id, count(*) AS requests FROM events GROUP BY 1, 2")
def stream_request_rates(spark, d):
    at = _work(spark, "stream-rates")
    events = stream.read_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.request_rates(events, "user_id", "ts", "1 day", None).select(F.unix_seconds("window.start").alias("begin_s"), "user_id", "requests")
    _finish(stream.rates_by_batch(out, f"{at}/out", f"{at}/checkpoint"))
    return spark.read.parquet(f"{at}/out").groupBy("begin_s", "user_id").agg(F.max("requests").alias("requests"))
