"""Learning what a host's titles begin and end with, by majority at every position."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SEPARATOR, TITLE_SPACE

MIN_PAGES, MIN_SHARE, MAX_SHARE, MAX_TITLES, MIN_AFFIX = 3, 0.6, 0.7, 256, 2
#: Numbers of titles at which a host is learned anew.
CHECKPOINTS = [MIN_PAGES * 2**k for k in range(int(math.log2(MAX_TITLES / MIN_PAGES)) + 1)]
_CUT = f"(?:{SEPARATOR}|{TITLE_SPACE})"


def learn_affixes(titles: DataFrame, order: str = "page_id") -> DataFrame:
    """host, pages, prefix and suffix for each host of (host, title, order) rows; only hosts with enough titles.

    At most the first 192 titles of a host matter, so the window keeps few rows of
    any host before the shuffle, and a hot host costs no more than others.
    """
    first = Window.partitionBy("host").orderBy(order)
    seen = titles.filter("host <> '' AND title <> ''").select("host", "title", F.row_number().over(first).alias("r")).filter(F.col("r") <= CHECKPOINTS[-1])
    n = F.count(F.lit(1)).over(Window.partitionBy("host"))
    used = F.greatest(*[F.when(F.col("n") >= c, c).otherwise(0) for c in CHECKPOINTS])
    kept = seen.withColumn("n", n).withColumn("m", used).filter("r <= m")
    size = F.length("title")
    limit = F.floor(F.min(size).over(Window.partitionBy("host")) * F.lit(MAX_SHARE))
    wide = kept.select("host", "m", "title", limit.cast("int").alias("lim")).filter("lim > 0")
    edges = wide.select("host", "m", "lim", F.explode(F.array(F.struct(F.lit("prefix").alias("end"), F.col("title").alias("t")), F.struct(F.lit("suffix").alias("end"), F.reverse("title").alias("t")))).alias("x"))
    chars = edges.select("host", "m", "x.end", F.posexplode(F.split(F.expr("substring(x.t, 1, lim)"), "")).alias("pos", "ch"))
    votes = chars.groupBy("host", "m", "end", "pos", "ch").count().filter(F.col("count") >= F.ceil(F.lit(MIN_SHARE) * F.col("m")))
    run = Window.partitionBy("host", "end").orderBy("pos")
    agreed = votes.withColumn("k", F.row_number().over(run) - 1).filter("k = pos")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda s: s["ch"]), "")
    affix = agreed.groupBy("host", "end").agg(text.alias("t"))
    prefix = F.max(F.when(F.col("end") == "prefix", F.regexp_extract("t", f"(?s)^(.*{_CUT})", 1)))
    suffix = F.max(F.when(F.col("end") == "suffix", F.regexp_extract(F.reverse("t"), f"(?s)({_CUT}.*)$", 1)))
    learned = affix.groupBy("host").agg(prefix.alias("prefix"), suffix.alias("suffix"))
    long_enough = lambda c: F.when(F.length(c) >= MIN_AFFIX, F.col(c)).otherwise("").alias(c)
    hosts = kept.groupBy("host").agg(F.max("m").alias("pages"))
    return hosts.join(learned, "host", "left").select("host", "pages", long_enough("prefix"), long_enough("suffix"))
