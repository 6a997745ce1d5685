"""Joins that stand skewed keys and lists of any length, and how small tables are laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one row in HEAVY_KEYS; so there are fewer than HEAVY_KEYS of them.
HEAVY_KEYS = 512
#: Key lists up to this many fixed-width rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def heavy_safe_join(facts: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``facts`` with one row per ``key`` in ``groups``, whatever the skew.

    ``size`` counts the facts of each group. Groups with more than one row in
    HEAVY_KEYS of ``total`` number fewer than HEAVY_KEYS, whatever the data, so
    they are broadcast; the remaining groups are small and go by shuffle.
    ``groups`` must be of fixed-width columns, and cheap to read twice.
    """
    bar = F.lit(total) / F.lit(float(HEAVY_KEYS))
    heavy = groups.filter((F.col(size) > bar) & (F.col(size) > 10_000))
    light = groups.filter(~((F.col(size) > bar) & (F.col(size) > 10_000)))
    if heavy.isEmpty():
        return facts.join(groups, key)
    hot = facts.join(F.broadcast(heavy), key)
    cold = facts.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(cold)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def filter_by_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` by distinct fixed-width ``keys``, null-safe.

    The list is counted first. A short one is broadcast, which spares a shuffle
    of wide rows; a long one is joined by sort and merge.
    """
    n = keys.count()
    if n == 0:
        return rows if how == "left_anti" else rows.limit(0)
    hinted = F.broadcast(keys) if n <= BROADCAST_ROWS else keys.hint("merge")
    return rows.join(hinted, same(rows, keys, on), how)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores, for work that takes long for each byte.

    A table of fewer files than there are cores may come as fewer tasks than cores, and is small
    enough to be shuffled; a larger one is left as it is read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores, key)
