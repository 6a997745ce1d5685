"""Robots rules as data: parsing, the group for an agent, decisions by path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url

MAX_HOST_DELAY = 60.0
GROUPS = "array<struct<agents:array<string>,rules:array<struct<allow:boolean,prefix:string>>>>"


def parse_robots(text: str) -> tuple[list[dict], float]:
    """Groups of agents and rules, and the last positive delay of the file."""
    groups: list[dict] = []
    delay = 0.0
    for raw in text.splitlines():
        key, colon, value = raw.partition("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not groups or groups[-1]["rules"]:
                groups.append({"agents": [], "rules": []})
            groups[-1]["agents"].append(value.lower())
        elif key in ("allow", "disallow") and groups:
            groups[-1]["rules"].append({"allow": key == "allow", "prefix": value})
        elif key == "crawl-delay":
            try:
                d = float(value)
            except ValueError:
                continue
            delay = d if d > 0 and d != float("inf") else delay
    return groups, delay


def robots_rules(files: DataFrame) -> DataFrame:
    """host, groups and delay of each (host, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(h, *parse_robots(t)) for h, t in zip(f["host"], f["text"])]
            yield pd.DataFrame(rows, columns=["host", "groups", "delay"])

    return files.select("host", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"host string, groups {GROUPS}, delay double")


def best_group(groups: Column, agent: str) -> Column:
    """The first group that names the agent, else the first for all."""
    ua = F.lit(agent.lower())
    named = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: (a != "") & (a != "*") & F.contains(ua, a)))
    anyone = F.filter(groups, lambda g: F.array_contains(g["agents"], F.lit("*")))
    return F.coalesce(F.get(named, F.lit(0)), F.get(anyone, F.lit(0)))


def allowed(rules: Column, path: Column) -> Column:
    """The longest prefix decides, allowing on ties; without one the path is free."""
    p = F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)
    hits = F.filter(rules, lambda r: (r["prefix"] != "") & F.startswith(p, r["prefix"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.octet_length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def decide(addresses: DataFrame, robots: DataFrame, agent: str, max_delay: float = MAX_HOST_DELAY, link: str = "url") -> DataFrame:
    """With delay_s and reason: delay, robots, or null for what may be fetched. A host without a file is free."""
    known = robots.select("host", best_group(F.col("groups"), agent).alias("_g"), F.col("delay").alias("_d"))
    joined = addresses.withColumn("host", url.host_of(F.col(link))).join(known, "host", "left")
    delay = F.when(F.col("_g").isNull(), 0.0).otherwise(F.coalesce("_d", F.lit(0.0)))
    path = F.coalesce(F.try_url_decode(F.regexp_replace(url.path(F.col(link)), r"\+", "%2B")), url.path(F.col(link)))
    free = F.col("_g").isNull() | allowed(F.col("_g")["rules"], path)
    return joined.withColumns({"delay_s": delay, "reason": F.when(delay > max_delay, "delay").when(~free, "robots")}).drop("_g", "_d")


def skip_report(decided: DataFrame) -> DataFrame:
    """Addresses and hosts by reason."""
    return decided.groupBy(F.coalesce("reason", F.lit("allowed")).alias("reason")).agg(F.count(F.lit(1)).alias("urls"), F.countDistinct("host").alias("hosts"))
