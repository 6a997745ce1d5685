"""Quality metrics of extraction, and ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text, url
from corpusloom.functions.page import Options
from corpusloom.operators import extract, templates, titles
from corpusloom.storage import Scratch


def extract_stats(results: DataFrame) -> DataFrame:
    """One row: pages, empty ones, sums of characters, and their shares and means."""
    n = F.count(F.lit(1))
    content, links, page = (F.coalesce(F.sum(c), F.lit(0)) for c in ("content_chars", "link_chars", "page_chars"))
    mean = lambda x: F.when(n == 0, 0.0).otherwise(x / n)
    empty = F.count_if(F.col("main_content") == "")
    return results.agg(
        n.alias("pages"), empty.alias("empty"), content.alias("content_chars"), links.alias("link_chars"), page.alias("page_chars"), mean(empty).alias("empty_share"), mean(content).alias("mean_content"),
        mean(page).alias("mean_page"), F.when(content == 0, 0.0).otherwise(links / content).alias("link_share"),
    )


def evaluate(outs: DataFrame, by: str = "variant", key: str = "key", site: str = "site") -> DataFrame:
    """A row of metrics for each value of ``by``, from (by, key, site, real_title, main_content, visible_chars)."""
    c = F.col("main_content")
    rows = outs.select(by, text.content_chars(c).alias("n"), text.metric_punct_count(c).alias("p"), F.col("visible_chars").alias("v"), (url.trim(F.col("real_title")) != "").alias("t"), F.contains(c, F.lit("\n")).alias("nl"))
    n = F.count(F.lit(1))
    share = lambda a, b: F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(a / b)
    sums = rows.groupBy(by).agg(
        share(F.count_if(F.col("n") == 0), n).alias("empty"), share(F.sum("n"), F.sum("v")).alias("coverage"), share(F.sum("p"), F.sum("n")).alias("punct"), share(F.count_if("t"), n).alias("title_ok"),
        share(F.sum("n"), n).alias("avg_chars"), share(F.count_if((F.col("n") > 200) & ~F.col("nl")), n).alias("single_line"),
    )
    left = templates.residue(outs, key, site, "main_content", (by,)).select(by, "residue")
    return sums.join(left, by, "left").select(by, "empty", "coverage", "punct", F.coalesce("residue", F.lit(0.0)).alias("residue"), "title_ok", "avg_chars", "single_line")


#: variant -> (options, with affixes, with templates)
VARIANTS = {
    "full": (Options(), True, True),
    "no-punct": (Options(no_punct=True), True, True),
    "no-link": (Options(no_link=True), True, True),
    "no-propagate": (Options(no_propagate=True), True, True),
    "no-chrome": (Options(), False, True),
    "no-template": (Options(), True, False),
    "single-page": (Options(), False, False),
}


def with_titles(pages: DataFrame) -> DataFrame:
    """page_id, host and title of pages, from their source."""
    return pages.select("page_id", url.host_of(F.col("url")).alias("host"), text.scan_title(F.col("html")).alias("title"))


def ablation(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row of metrics for each variant.

    A page is parsed once for all variants. Those that differ only by templates share an extraction, and
    all of them are cut and measured in one plan, whose sites are a variant's hosts. What the parser
    gives is written out, since several aggregates read it.
    """
    scratch = Scratch(pages.sparkSession, "ablation")
    kinds: dict[tuple, list[str]] = {}
    for name in names or list(VARIANTS):
        options, with_affixes, _ = VARIANTS[name]
        kinds.setdefault((options, with_affixes), []).append(name)
    known = titles.learn_affixes(with_titles(pages))
    seen = pages.withColumn("visible_chars", text.visible_chars(F.col("html")))
    own = F.element_at(F.array(*[F.array(*map(F.lit, own)) for own in kinds.values()]), F.col("way") + 1)
    outs = extract.extract_each(seen, known, list(kinds), ("page_id", "visible_chars")).select(F.explode(own).alias("variant"), "page_id", "host", "visible_chars", "real_title", "main_content")
    outs = scratch.write("extracted", outs.withColumns({"key": F.concat_ws(" ", "variant", "page_id"), "site": F.concat_ws(" ", "variant", "host")}))
    cutting = [name for own in kinds.values() for name in own if VARIANTS[name][2]]
    learned = templates.learn_templates(outs.filter(F.col("variant").isin(cutting)), "site", "main_content", "key")
    cut = templates.stripped(outs, learned, "site", "main_content").withColumn("main_content", F.col("stripped")).drop("stripped")
    return evaluate(scratch.write("cut", cut))


def markdown(rows: list) -> str:
    """The report of collected metric rows."""
    head = "| variant | empty | coverage | punct | residue | title ok | avg chars | single line |\n|---|---|---|---|---|---|---|---|\n"
    line = lambda r: f"| {r['variant']} | {r['empty']:.1%} | {r['coverage']:.1%} | {r['punct']:.3f} | {r['residue']:.2%} | {r['title_ok']:.1%} | {r['avg_chars']:.0f} | {r['single_line']:.1%} |\n"
    return head + "".join(map(line, rows))
