"""Connected components of a table of links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """v and label, the smallest vertex of v's component, for the ends of ``links`` (a, b).

    Every round passes each vertex the smallest label around it and then follows
    the label's own label, so that long chains halve. Each round is written out,
    which cuts the lineage and survives lost executors. A vertex with many links
    gives one minimum per map task before the shuffle.
    """
    run = uuid.uuid4().hex[:8]
    edges = scratch.write(f"{run}-edges", links.select("a", "b").union(links.select("b", "a")).distinct().toDF("v", "w"))
    first = edges.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label"))
    labels = scratch.write(f"{run}-labels-0", first)
    step = 0
    while True:
        step += 1
        near = edges.join(labels.toDF("w", "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        lower = scratch.write(f"{run}-lower-{step}", lower)
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label", "left").select("v", F.least("label", F.coalesce("further", "label")).alias("label"), "was")
        written = scratch.write(f"{run}-labels-{step}", moved)
        changed = written.filter("label <> was").isEmpty()
        scratch.drop(f"{run}-lower-{step}", f"{run}-labels-{step - 1}")
        labels = written.select("v", "label")
        if changed:
            scratch.drop(f"{run}-edges")
            return labels
