"""Readers and writers of the formats that crawls exchange. All read by DataFrame sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import url


def parse_page_lines(lines: DataFrame) -> DataFrame:
    """url, title and html of JSON lines (column value).

    Blank lines give no row; a line that isn't a JSON object gives an empty one, so
    that the number of rows is that of the lines; so does one whose url, title or html is
    anything but a string or null.
    """
    given = lines.filter(F.length(F.regexp_replace("value", r"[\r\n]+$", "")) > 0)
    names = ("url", "title", "html")
    j = F.from_json("value", "url string, title string, html string")
    v = F.try_parse_json("value")
    kind = lambda c: F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant"))
    fine = F.coalesce(reduce(lambda a, b: a & b, (F.coalesce(kind(c), F.lit("VOID")).isin("STRING", "VOID") for c in names)), F.lit(False))
    return given.select(*[F.when(fine, F.coalesce(j[c], F.lit(""))).otherwise(F.lit("")).alias(c) for c in names])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return parse_page_lines(spark.read.text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: trimmed lines that aren't blank."""
    return spark.read.text(path).select(url.trim(F.col("value")).alias("line")).filter("line <> ''")


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """host: sorted distinct hosts of a seed list."""
    hosts = spark.read.text(path).select(url.seed_host(F.col("value")).alias("host"))
    return hosts.filter("host IS NOT NULL").distinct().orderBy("host")


def read_seed_json(spark: SparkSession, path: str) -> DataFrame:
    """host: distinct hosts of the url fields of JSON lines; bad lines are skipped."""
    u = F.from_json("value", "url string")["url"]
    return spark.read.text(path).select(url.seed_host(u).alias("host")).filter("host IS NOT NULL").distinct()


def read_crawl_seeds(spark: SparkSession, path: str) -> DataFrame:
    """url: the addresses of a seed file, with a scheme."""
    return spark.read.text(path).select(url.seed_url(F.col("value")).alias("url")).filter("url IS NOT NULL")


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """url: addresses in JSON output so far; torn or bad lines and lines without one are ignored."""
    u = F.from_json("value", "url string")["url"]
    return spark.read.text(path).select(u.alias("url")).filter("url IS NOT NULL AND url <> ''").distinct()


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """value (the line as it is), host and content_chars of JSON lines; bad lines are dropped."""
    from corpusloom.operators.sample import sample_host

    j = F.from_json("value", "url string, final_url string, host string, main_content string, content_chars int")
    rows = spark.read.text(path).filter(F.try_parse_json("value").isNotNull()).withColumn("j", j)
    return rows.select("value", sample_host(F.col("j.host"), F.col("j.final_url"), F.col("j.url")).alias("host"), F.coalesce("j.content_chars", F.lit(0)).alias("content_chars"), F.coalesce("j.main_content", F.lit("")).alias("main_content"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """ts, host and url of a tab-separated request trace."""
    return spark.read.csv(path, sep="\t", schema="ts timestamp, host string, url string")


def truncated(pages: DataFrame, max_bytes: int = 5 << 20) -> DataFrame:
    """With the flag of bodies longer than the cap."""
    return pages.withColumn("truncated", F.octet_length("html") > max_bytes)


def write_results(df: DataFrame, path: str) -> None:
    """The four public fields as JSON lines."""
    df.select("url", "meta_title", "real_title", "main_content").write.mode("append").json(path)


def write_entries(df: DataFrame, path: str) -> None:
    """Append result rows to a Parquet store; rows without a url are refused, a missing time is now."""
    rows = df.filter("coalesce(url, '') <> ''").withColumn("fetched_at", F.coalesce("fetched_at", F.current_timestamp()) if "fetched_at" in df.columns else F.current_timestamp())
    rows.write.mode("append").parquet(path)


def write_queue(df: DataFrame, path: str) -> None:
    df.select("url").write.mode("append").text(path)


def write_hosts(df: DataFrame, path: str) -> None:
    df.select("host").distinct().orderBy("host").write.mode("overwrite").text(path)


def write_trace(df: DataFrame, path: str) -> None:
    df.select("ts", "host", "url").write.mode("append").csv(path, sep="\t")


def write_sample_urls(df: DataFrame, path: str) -> None:
    df.select("url", "visible_chars").write.mode("overwrite").csv(path, sep="\t")


def align(corpus: DataFrame, results: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """``corpus`` with the fields of another program's results by ``key``: the last of repeated ones, empty if there is none."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    one = results.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(key, *fields)
    return corpus.join(one, key, "left").select(*corpus.columns, *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields])
