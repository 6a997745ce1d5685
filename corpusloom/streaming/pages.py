"""Extraction and monitoring as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import page, text, url
from corpusloom.operators import extract, titles

_ONLINE = f"page_id bigint, url string, host string, {extract.RESULT}"
_COLUMNS = [x.split()[0] for x in _ONLINE.split(", ")]


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table's files as a stream; the limit on files is the back pressure."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def extract_by_batch(pages: DataFrame, titles_path: str, out_path: str, checkpoint: str):
    """Start a query that learns from every batch's titles first, then extracts the batch with what all titles so far tell.

    Titles are kept in a table by batch, so a batch that is run again overwrites its own part.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select("page_id", url.host_of(F.col("url")).alias("host"), text.scan_title(F.col("html")).alias("title"))
        own.withColumn("place", F.struct(F.lit(number).alias("batch"), "page_id")).write.mode("overwrite").parquet(f"{titles_path}/batch={number}")
        seen = spark.read.parquet(titles_path).filter(F.col("batch") <= number)
        known = titles.learn_affixes(seen.select("host", "title", "place"), "place")
        extract.extract_pages(batch, known).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn(seen: list[str]) -> tuple[str, str]:
    """Prefix and suffix of one host's titles, as ``titles.learn_affixes`` has them."""
    if len(seen) < titles.MIN_PAGES:
        return "", ""
    m = max(c for c in titles.CHECKPOINTS if c <= len(seen))
    used = seen[:m]
    limit = int(min(map(len, used)) * titles.MAX_SHARE)

    def edge(rows: list[str]) -> str:
        out = ""
        for k in range(limit):
            votes = pd.Series([r[k] for r in rows]).value_counts()
            if votes.iloc[0] < titles.MIN_SHARE * m:
                break
            out += votes.index[0]
        return out

    cuts = page.SEPARATORS + page.TITLE_SPACE
    prefix = edge(used)
    suffix = edge([r[::-1] for r in used])[::-1]
    end = max((i for i, c in enumerate(prefix) if c in cuts), default=-1)
    begin = next((i for i, c in enumerate(suffix) if c in cuts), len(suffix))
    prefix, suffix = prefix[: end + 1], suffix[begin:]
    return prefix if len(prefix) >= titles.MIN_AFFIX else "", suffix if len(suffix) >= titles.MIN_AFFIX else ""


def extract_online(pages: DataFrame, idle: str | None = None) -> DataFrame:
    """Every page extracted with what its host's earlier pages tell; then its own title is observed.

    State is a host's first titles, 256 at most. Within a batch, pages count in the order of page_id.
    """

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("page_id")
        known = learn(seen)
        out = []
        for i, u, html in zip(rows["page_id"], rows["url"], rows["html"]):
            r = extract.extract_one(html, *known)
            out.append((i, u, key[0], *r.values()))
            if key[0] and r["meta_title"] and len(seen) < titles.MAX_TITLES:
                seen.append(r["meta_title"])
                if len(seen) in titles.CHECKPOINTS:
                    known = learn(seen)
        state.update((seen,))
        yield pd.DataFrame(out, columns=_COLUMNS)

    given = pages.select("page_id", "url", "html", F.coalesce(url.host_of(F.col("url")), F.lit("")).alias("host"))
    return given.groupBy("host").applyInPandasWithState(each, _ONLINE, "titles array<string>", "append", GroupStateTimeout.NoTimeout)


def first_seen(addresses: DataFrame) -> DataFrame:
    """Each normalized address once, over the whole stream."""
    norm = addresses.select(url.normalize(F.col("url")).alias("url_norm"), url.host_key(url.trim(F.col("url"))).alias("host"))
    return norm.filter("url_norm IS NOT NULL").dropDuplicates(["url_norm"])


def request_rates(requests: DataFrame, host: str, ts: str, window: str = "1 hour", late: str | None = "1 day") -> DataFrame:
    """Requests of each host by event-time window; rows later than ``late`` are left out and closed windows' state is dropped. Without it, all count."""
    return (requests.withWatermark(ts, late) if late else requests).groupBy(F.window(ts, window), host).agg(F.count(F.lit(1)).alias("requests"))


def rates_by_batch(rates: DataFrame, out_path: str, checkpoint: str):
    """Start a query that writes, of each batch, the windows that it changed. A window's count only grows, so its largest is its last."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return rates.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
