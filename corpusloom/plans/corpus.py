"""End-to-end plans over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url
from corpusloom.operators import extract, frontier, metrics, templates, titles
from corpusloom.storage import Scratch


def build_corpus(pages: DataFrame, min_content: int = 300, max_link_rate: float = 0.3) -> DataFrame:
    """page_id, url, host, the titles, main content without the host's boilerplate, and the article flag.

    The flag goes by what was extracted, before boilerplate is cut.
    """
    known = titles.learn_affixes(metrics.with_titles(pages))
    outs = extract.is_article(extract.extract_pages(pages, known), min_content, max_link_rate)
    # read more than once below, so it is written: the parser would run each time
    outs = Scratch(pages.sparkSession, "corpus").write("extracted", outs)
    cut = templates.stripped(outs, templates.learn_templates(outs, "host", "main_content", "page_id"), "host", "main_content")
    return cut.select("page_id", "url", "host", "meta_title", "real_title", F.col("stripped").alias("main_content"), "content_chars", "link_rate", "is_article")


def replay(pages: DataFrame, per_host: int = 5, cap: int = 12, delay: float = 1.5) -> DataFrame:
    """A crawl of what is in a table: each host's queue, its schedule, and an end after ``per_host`` articles."""
    queued = frontier.schedule(frontier.queue(pages, cap), delay)
    outs = extract.is_article(extract.extract_pages(pages.join(queued.select("page_id"), "page_id", "left_semi")))
    done = queued.join(outs.select("page_id", "is_article", "content_chars"), "page_id")
    return frontier.until_target(done, "host", ["place"], F.col("is_article"), per_host)


def seeds(lines: DataFrame, *more: DataFrame) -> DataFrame:
    """Sorted distinct hosts of any number of seed lists (column value)."""
    out = lines.select("value")
    for m in more:
        out = out.unionByName(m.select("value"))
    return out.select(url.seed_host(F.col("value")).alias("host")).filter("host IS NOT NULL").distinct().orderBy("host")
