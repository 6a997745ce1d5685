"""Links, ranking and the choice of what to read next."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import url
from corpusloom.functions.html import tokens
from corpusloom.joins import spread


def hrefs(html: str) -> Iterator[str]:
    """Addresses of a page's anchors, in document order."""
    for kind, tag, attrs in tokens(html):
        if kind == "start" and tag == "a":
            h = attrs.get("href", "").strip()
            if h and not h.startswith("#"):
                yield h


def resolve(base: str, href: str) -> str | None:
    """The absolute web address without its fragment, odd bytes of its path escaped."""
    try:
        u = urlsplit(urljoin(base, href))
        if u.scheme not in ("http", "https") or not u.netloc:
            return None
        return u._replace(path=quote(u.path, safe="/%:@!$&'()*+,;=~-._"), fragment="").geturl()
    except ValueError:
        return None


def page_links(base: str, html: str) -> list[str]:
    """Distinct links to the page's own host, in document order."""
    own = urlsplit(base).netloc.lower()
    found = (resolve(base, h) for h in hrefs(html))
    return list(dict.fromkeys(x for x in found if x and urlsplit(x).netloc.lower() == own))


def page_hosts(base: str, html: str) -> list[str]:
    """Distinct hosts of links that leave the page's host, in document order."""
    own = (urlsplit(base).hostname or "").removesuffix(".")
    found = (urlsplit(x).hostname or "" for x in (resolve(base, h) for h in hrefs(html)) if x)
    return [h for h in dict.fromkeys(x.removesuffix(".") for x in found) if h and h != own and "." in h]


def _listed(pages: DataFrame, fn, name: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, u, k, x) for i, u, h in zip(f["page_id"], f["url"], f["html"]) for k, x in enumerate(fn(u, h))]
            yield pd.DataFrame(rows, columns=["page_id", "page_url", "pos", name])

    given = spread(pages.select("page_id", "url", "html"), "page_id").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return given.mapInPandas(run, f"page_id bigint, page_url string, pos int, {name} string")


def links(pages: DataFrame) -> DataFrame:
    """page_id, page_url, pos and link of every same-host link."""
    return _listed(pages, page_links, "link")


def harvest_hosts(pages: DataFrame) -> DataFrame:
    """page_id, page_url, pos and host of every host that pages link to, blocked ones left out."""
    return _listed(pages, page_hosts, "host").filter(~url.is_blocked(F.col("host")))


def source_links(pages: DataFrame) -> DataFrame:
    """page_id, pos and href of double-quoted anchors, by patterns alone; for well-formed sources."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?i)<a\s[^>]*?href="([^"#][^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def pick_articles(candidates: DataFrame, most: int, host: str = "host", link: str = "url", order: str = "pos") -> DataFrame:
    """The best-ranked article-like links of each host, ``most`` at most; ties in document order.

    The rank limit is applied within map tasks first, so a hot host sends few rows.
    """
    best = Window.partitionBy(host).orderBy(F.col("score").desc(), order)
    scored = candidates.filter(url.looks_like_article(F.col(link))).withColumn("score", url.rank(F.col(link)))
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def pick_sections(candidates: DataFrame, most: int = 8, host: str = "host", link: str = "url", order: str = "pos") -> DataFrame:
    """Shallow section pages of each host: neither functional nor the root, distinct, ``most`` at most."""
    first = candidates.filter(~url.is_functional(F.col(link)) & (url._inner(F.col(link)) != "")).groupBy(host, link).agg(F.min(order).alias(order))
    shallow = Window.partitionBy(host).orderBy("depth", order)
    return first.withColumn("depth", url.depth(F.col(link))).withColumn("rank", F.row_number().over(shallow)).filter(F.col("rank") <= most)


def harvest_directories(directories: DataFrame, pages: DataFrame, sections: int = 8) -> DataFrame:
    """Distinct hosts that directory hosts lead to: from their home pages and those pages' sections, one hop.

    ``pages`` (page_id, url, html) holds what was fetched; ``directories`` has a column host.
    """
    homes = pages.withColumn("host", url.hostname(F.col("url"))).filter(url._inner(F.col("url")) == "").join(directories, "host", "left_semi")
    found = links(homes).withColumn("host", url.hostname(F.col("page_url"))).withColumnRenamed("link", "url")
    wanted = pick_sections(found, sections).select("url").distinct()
    more = pages.join(wanted, "url", "left_semi")
    return harvest_hosts(homes.select("page_id", "url", "html")).select("host").union(harvest_hosts(more).select("host")).distinct()


def probe_alive(fetched: DataFrame, min_cjk: int = 50) -> DataFrame:
    """host and alive: whether some fetch of the host had status 200 and enough CJK text."""
    from corpusloom.functions.text import cjk_count

    good = (F.col("status") == 200) & (cjk_count(F.col("html")) >= min_cjk)
    return fetched.groupBy("host").agg(F.max(good).alias("alive"))
