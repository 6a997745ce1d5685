"""Scheduling and politeness over tables of addresses and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import url

MAX_HOST_DELAY = 60.0


def dedupe(addresses: DataFrame, link: str = "url", order: str = "page_id") -> DataFrame:
    """The first row of each normalized address: url_norm, host and order. Anything but web addresses is dropped."""
    norm = addresses.select(url.normalize(F.col(link)).alias("url_norm"), url.host_key(url.trim(F.col(link))).alias("host"), order)
    return norm.filter("url_norm IS NOT NULL").groupBy("url_norm").agg(F.first("host").alias("host"), F.min(order).alias(order))


def queue(addresses: DataFrame, cap: int, link: str = "url", order: str = "page_id") -> DataFrame:
    """Distinct addresses in each host's queue order, ``cap`` for a host at most."""
    place = Window.partitionBy("host").orderBy(order)
    return dedupe(addresses, link, order).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= cap)


def schedule(queued: DataFrame, delay: float, host_delays: DataFrame | None = None) -> DataFrame:
    """With the second at which each request may start; a host's own delay only slows it."""
    gap: Column = F.lit(delay)
    if host_delays is not None:
        queued = queued.join(host_delays.select("host", F.col("delay").alias("own")), "host", "left")
        gap = F.greatest(F.lit(delay), F.coalesce("own", F.lit(0.0)))
    return queued.withColumn("start_s", (F.col("place") - 1) * gap).drop("own")


def next_wait(scheduled: DataFrame, now: float) -> DataFrame:
    """One row: seconds until a request is due, null without any."""
    return scheduled.filter(F.col("start_s") >= now).agg((F.min("start_s") - F.lit(now)).alias("wait_s"))


def gaps(requests: DataFrame, host: str, ts: str, tie: str) -> DataFrame:
    """Requests with the seconds since the same host's previous one (null for the first)."""
    order = Window.partitionBy(host).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return requests.withColumn("gap_s", (micros - F.lag(micros).over(order)) / F.lit(1e6))


def violations(requests: DataFrame, host: str, ts: str, tie: str, delay: float) -> DataFrame:
    """For each host: requests, gaps below the delay, the smallest gap."""
    return gaps(requests, host, ts, tie).groupBy(host).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("gap_s") < delay - 1e-5).alias("violations"), F.min("gap_s").alias("min_gap_s"))


def until_target(requests: DataFrame, host: str, order: list[str], hit: Column, target: int) -> DataFrame:
    """The requests that are made before the host has ``target`` hits; 0 is no limit."""
    if target == 0:
        return requests
    before = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("_h", F.coalesce(F.sum(hit.cast("int")).over(before), F.lit(0))).filter(F.col("_h") < target).drop("_h")


def failure_streaks(requests: DataFrame, host: str, order: list[str], failed: Column) -> DataFrame:
    """With ``streak``: failures in a row up to and with this request."""
    w = Window.partitionBy(host).orderBy(*order)
    run = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = requests.withColumns({"_f": failed.cast("int"), "_run": run})
    streak = F.sum("_f").over(Window.partitionBy(host, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", streak).drop("_f", "_run")


def abandoned(requests: DataFrame, host: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """host and the order value at which it is given up, after ``most`` failures in a row; later requests are dropped."""
    return failure_streaks(requests, host, order, failed).filter(F.col("streak") >= most).groupBy(host).agg(F.min(F.struct(*order)).alias("at"))


def before_abandoning(requests: DataFrame, host: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """The requests made until a host is given up, that one included."""
    at = abandoned(requests, host, order, failed, most)
    return requests.join(at, host, "left").filter(F.col("at").isNull() | (F.struct(*order) <= F.col("at"))).drop("at")


def not_done(tasks: DataFrame, done: DataFrame, link: str = "url") -> DataFrame:
    """Tasks whose address isn't among the done ones."""
    return tasks.join(done.select(link), link, "left_anti")


def queue_stats(scheduled: DataFrame, now: float, busy_s: float) -> DataFrame:
    """hosts, queued and in-flight requests at a second of the schedule."""
    s = F.col("start_s")
    state = F.when(s > now, "queued").when(s > now - busy_s, "busy").otherwise("done")
    return scheduled.withColumn("state", state).groupBy("state").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("host").alias("hosts"))


def crawl_report(requests: DataFrame, host: str, failed: Column, article: Column, empty: Column, size: Column) -> DataFrame:
    """One row of a crawl's counters."""
    return requests.agg(
        F.count(F.lit(1)).alias("pages"), F.countDistinct(host).alias("hosts"), F.count_if(article).alias("articles"), F.count_if(failed).alias("failed"), F.count_if(empty).alias("empty"),
        F.coalesce(F.sum(F.when(~failed, size)), F.lit(0)).alias("bytes"), F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.count_if(article) / F.count(F.lit(1))).alias("article_share"),
    )


def persistence_check(handled: DataFrame, saved: DataFrame, link: str = "url", share: float = 0.98) -> DataFrame:
    """One row: handled and saved addresses, and whether enough of them were saved."""
    a = handled.agg(F.countDistinct(link).alias("handled"))
    b = saved.agg(F.countDistinct(link).alias("saved"))
    return a.crossJoin(b).withColumn("persisted", F.col("saved") >= F.lit(share) * F.col("handled"))  # one row by one row


def retryable(status: Column, network_error: Column) -> Column:
    """Whether a fetch is worth another attempt."""
    return network_error | status.between(500, 599) | (status == 429)


def attempts_wait(attempt: Column) -> Column:
    """Seconds before attempt k (from 1): half a second times k."""
    return attempt * F.lit(0.5)
