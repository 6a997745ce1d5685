"""Equidistant and stratified samples, and their report."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from corpusloom.joins import BROADCAST_ROWS, heavy_safe_join
from corpusloom.storage import Scratch


def sample_host(host: Column, final_url: Column, link: Column) -> Column:
    """The host a row is sampled under."""
    from corpusloom.functions.url import authority

    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", None).otherwise(c)
    return F.coalesce(blank(host), blank(authority(final_url)), blank(authority(link)), F.lit("(未知)"))


def every_nth(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows at the places floor(i * total / n) of the order; all if there are no more.

    Rows of equal order go by their contents. Only the order's columns are sorted; the rows at the
    wanted places are looked up afterwards.
    """
    total = rows.count()
    if n >= total:
        return rows
    keys, given = _keyed(rows, order)
    # floor(i * total / n) = p for some i  <=>  ceil(p * n / total) * total / n < p + 1
    i = F.ceil(F.col("_p") * F.lit(n) / F.lit(total)).cast("bigint")
    picks = numbered(given.select(*keys), keys, "_p").filter((i < n) & (F.floor(i * F.lit(total) / F.lit(n)) == F.col("_p"))).drop("_p")
    return _at(given, picks, keys).select(*[F.col(f"`{c}`") for c in rows.columns])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """With each row's place, from 0, in the order.

    Ranges are sorted each in its task and written with every row's place within its range; sizes of
    ranges, a row each, give the places before. Both are read from the one written table, since ranges
    come from a sample and would differ if they were drawn again.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "numbered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = scratch.write("ranged", ranged.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(name)))
    sizes = ranged.groupBy("_part").agg((F.max(name) + 1).alias("count"))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def _keyed(rows: DataFrame, order: list[str]) -> tuple[list[str], DataFrame]:
    """The names of an order without ties but for equal rows, and ``rows`` with it: the order's columns and a hash of all."""
    tie = f"_tie_{uuid.uuid4().hex[:8]}"
    whole = [F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in rows.schema]
    return [*order, tie], rows.withColumn(tie, F.xxhash64(*whole))


def _at(given: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the picked keys; of equal rows, as many as were picked."""
    names = [f"_k{i}" for i in range(len(keys))]
    wanted = picks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_wanted")).toDF(*names, "_wanted")
    few = wanted.count() <= BROADCAST_ROWS
    cond = reduce(lambda a, b: a & b, (given[k].eqNullSafe(wanted[x]) for k, x in zip(keys, names)))
    found = given.join(F.broadcast(wanted) if few else wanted.hint("merge"), cond)
    again = Window.partitionBy(*names).orderBy(names[-1])
    return found.withColumn("_again", F.row_number().over(again)).filter("_again <= _wanted").drop("_again", "_wanted", *names)


def _strides(place: Column, total: Column, n: int) -> Column:
    """Whether a place is round(i * (total - 1) / (n - 1)) for some i below n, halves to even.

    Places are no closer than 1, so only the i at a row's own share of the way, or next to it, can be meant.
    """
    if n == 1:
        return place == 0
    near = F.floor(place * F.lit(n - 1) / F.greatest(total - 1, F.lit(1)))
    hit = lambda i: (i >= 0) & (i < n) & (F.bround(i * (total - 1) / F.lit(float(n - 1)), 0).cast("bigint") == place)
    return (total <= n) | hit(near - 1) | hit(near) | hit(near + 1)


def stratified(rows: DataFrame, host: str, order: list[str], per_host: int, cap: int = 0) -> DataFrame:
    """At most ``per_host`` evenly spread rows of each host, then evenly thinned to ``cap`` in host order.

    Places within a host are places in the order by host, less the host's first, so that a host of
    any size is spread over tasks.
    """
    if per_host <= 0:
        return rows.limit(0)
    keys, given = _keyed(rows, list(dict.fromkeys([host, *order])))
    scratch = Scratch(rows.sparkSession, "stratified")
    placed = numbered(given.select(*keys), keys, "_p").withColumn("_host", F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")))
    hosts = scratch.write("hosts", placed.groupBy("_host").agg(F.min("_p").alias("_first"), F.count(F.lit(1)).alias("_n")))
    marked = heavy_safe_join(placed, hosts, "_host", "_n", placed.count())
    picked = marked.filter(_strides(F.col("_p") - F.col("_first"), F.col("_n"), per_host)).select(*keys)
    picked = scratch.write("picked", picked)
    total = picked.count() if cap > 0 else 0
    if cap > 0 and total > cap:
        picked = numbered(picked, keys, "_p").filter(_strides(F.col("_p"), F.lit(total), cap)).drop("_p")
    return _at(given, picked, keys).select(*[F.col(f"`{c}`") for c in rows.columns])


def report(rows: DataFrame, host: str, chars: Column) -> DataFrame:
    """One row: rows, hosts, empty share, order statistics of the lengths (by place, not interpolated), share of 300 and more.

    Lengths are counted by value first, so what is sorted are distinct lengths, not rows.
    """
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(host).alias("hosts"), F.count_if(chars == 0).alias("empty"), F.count_if(chars >= 300).alias("long"))
    counts = rows.groupBy(chars.alias("c")).count()
    upto = F.sum("count").over(Window.orderBy("c"))
    cum = counts.select("c", upto.alias("upto"), F.sum("count").over(Window.partitionBy()).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))), F.col("c")))
    quant = cum.agg(F.min("c").alias("min_chars"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), F.max("c").alias("max_chars"))
    share = lambda c: F.when(F.col("rows") == 0, 0.0).otherwise(F.col(c) / F.col("rows"))
    return sums.crossJoin(quant).select("rows", "hosts", share("empty").alias("empty_share"), "min_chars", "p25", "median", "p75", "max_chars", share("long").alias("long_share"))  # one row by one row
