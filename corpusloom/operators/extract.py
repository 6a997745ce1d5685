"""Page extraction over tables. The parser is the one Python operator; all else is Column code."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import page, url
from corpusloom.functions.html import Node, parse
from corpusloom.joins import BROADCAST_ROWS, spread
from corpusloom.storage import Scratch, shared_dir

RESULT = "meta_title string, real_title string, main_content string, content_chars int, link_chars int, link_rate double, page_chars int, page_link_rate double, container_tag string, no_article boolean"
_EMPTY = {"meta_title": "", "real_title": "", "main_content": "", "content_chars": 0, "link_chars": 0, "link_rate": 0.0, "page_chars": 0, "page_link_rate": 0.0, "container_tag": "", "no_article": True}
#: Pages whose rows are put out at once.
PAGES = 500


def extract_one(html: str | None, prefix: str = "", suffix: str = "", options: page.Options = page.Options()) -> dict:
    """Extraction of a page; a page that fails gives an empty result and its neighbours go on."""
    return extract_ways(html, prefix, suffix, [(options, True)])[0]


def extract_ways(html: str | None, prefix: str, suffix: str, ways: list[tuple[page.Options, bool]]) -> list[dict]:
    """``extract_one`` in each way, with affixes or without, from one parse."""
    known = page.Affixes(prefix or "", suffix or "")
    try:
        return page.extract_each(html or "", [(known if with_affixes else page.Affixes(), o) for o, with_affixes in ways])
    except Exception:  # noqa: BLE001 - one page never fails a job
        return [extract_one(html, *((prefix, suffix) if with_affixes else ("", "")), o) for o, with_affixes in ways] if len(ways) > 1 else [_EMPTY]


def extract_pages(pages: DataFrame, affixes: DataFrame | None = None, options: page.Options = page.Options(), keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, host and the extraction of every page.

    Affixes (host, prefix, suffix) are one short row for each host. They are written and counted;
    few are broadcast, so that a host of many pages stays spread over tasks.
    """
    return extract_each(pages, affixes, [(options, affixes is not None)], keep).drop("way")


def extract_each(pages: DataFrame, affixes: DataFrame | None, ways: list[tuple[page.Options, bool]], keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``extract_pages`` in each way (options, with affixes), a row for each with its place among the ways."""
    given = spread(pages.select(*dict.fromkeys((*keep, "page_id", "url", "html"))), "page_id").select(*keep, F.coalesce(url.host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    if affixes is not None:
        affixes = Scratch(pages.sparkSession, "affixes").write("affixes", affixes.select("host", "prefix", "suffix"))
        affixes = F.broadcast(affixes) if affixes.count() <= BROADCAST_ROWS else affixes
        given = given.join(affixes, "host", "left").select(*given.columns, F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    else:
        given = given.withColumns({"prefix": F.lit(""), "suffix": F.lit("")})
    kept = [*keep, "host"]
    k = len(ways)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), PAGES):
                own = f.iloc[at : at + PAGES]
                rows = [r for x in zip(own["html"], own["prefix"], own["suffix"]) for r in extract_ways(*x, ways)]
                again = own[kept].loc[own.index.repeat(k)].reset_index(drop=True)
                yield pd.concat([again, pd.DataFrame({"way": list(range(k)) * len(own)}, dtype="int32"), pd.DataFrame(rows, columns=list(_EMPTY))], axis=1)

    ddl = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in kept)
    return given.mapInPandas(run, f"{ddl}, way int, {RESULT}")


def is_article(df: DataFrame, min_content: int = 300, max_link_rate: float = 0.3) -> DataFrame:
    """With the flag by which a crawl counts a page as an article."""
    good = ~F.col("no_article") & (F.col("content_chars") >= min_content) & (F.col("link_rate") <= max_link_rate)
    return df.withColumn("is_article", good)


def verdict(container_tag, link_rate, content_chars):
    """The page verdict as a Column."""
    bad = ["", "html", "body", *sorted(page.NOT_PROSE)]
    return ~container_tag.isin(bad) & (link_rate <= 0.5) & (content_chars >= 80)


def dom_nodes(pages: DataFrame) -> DataFrame:
    """A row for every element of the pruned tree: page_id, node, parent, tag, depth, post (post-order), chars, punct, links, elements, own, total."""
    schema = "page_id bigint, node int, parent int, tag string, depth int, post int, chars int, punct int, links int, elements int, own double, total double"

    def rows(page_id: int, html: str) -> Iterator[tuple]:
        doc = parse(html)
        page.prune(doc)
        stats, order = page.text_stats(doc)
        _, total = page.pick_container(order, stats, page.Options())
        number = {n: i for i, n in enumerate(x for x in doc.elements() if x.tag != "#document")}
        level: dict[Node, int] = {doc: -1}
        for n in doc.elements():
            if n is not doc:
                level[n] = level[n.parent] + 1
        for post, n in enumerate(order):
            s = stats[n]
            own = page.block_score(s, page.Options()) if n.tag in page.CANDIDATES else 0.0
            yield page_id, number[n], number.get(n.parent), n.tag, level[n], post, s.chars, s.punct, s.links, s.elements, own, total[n]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for f in frames:
            out = pd.DataFrame([r for i, h in zip(f["page_id"], f["html"]) for r in rows(i, h)], columns=names)
            yield out.astype({"parent": "Int32"})

    return spread(pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")), "page_id").mapInPandas(run, schema)


def containers(nodes: DataFrame) -> DataFrame:
    """The container of each page from its ``dom_nodes``, by joins: the best block, then up while the sum holds.

    A step up is a link from a node to its parent. The links double their reach in each round, over
    written tables, until no page has a link left to follow; pages and depths are without a limit.
    """
    spark = nodes.sparkSession
    path = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, urlparse(path).path, ignore_errors=True)

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    rate = F.when(F.col("chars") > 0, F.col("links") / F.col("chars")).otherwise(0.0)
    view = written("nodes", nodes.select("page_id", "node", "parent", "tag", "own", "total", "post", rate.alias("rate")))
    best = view.filter("own > 0").groupBy("page_id").agg(F.max_by("node", F.struct("total", -F.col("post"))).alias("node"), F.max_by("total", F.struct("total", -F.col("post"))).alias("base"))
    best = written("best", best)
    above = view.join(best.select("page_id", "base"), "page_id").filter("tag NOT IN ('html', 'body') AND total >= 0.75 * base").select("page_id", F.col("node").alias("parent"), F.col("rate").alias("above"))
    links = view.join(above, ["page_id", "parent"]).filter("above <= rate + 0.10")
    links = written("links-0", links.select("page_id", "node", F.col("parent").alias("to")).distinct())
    at = best.select("page_id", "node")
    k = 0
    while not at.join(links, ["page_id", "node"], "left_semi").isEmpty():
        k += 1
        at = written(f"at-{k}", at.join(links, ["page_id", "node"], "left").select("page_id", F.coalesce("to", "node").alias("node")))
        further = links.select("page_id", F.col("node").alias("to"), F.col("to").alias("beyond"))
        links = written(f"links-{k}", links.join(further, ["page_id", "to"], "left").select("page_id", "node", F.coalesce("beyond", "to").alias("to")))
    return at.join(view, ["page_id", "node"]).groupBy("page_id").agg(F.first("node").alias("node"), F.first("tag").alias("container_tag"))
