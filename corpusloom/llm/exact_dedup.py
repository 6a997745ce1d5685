"""Exact deduplication against a persistent digest index (native).

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
normalised text. A batch of documents is reduced to one row per digest, which
is anti-joined with the index by sort and merge, on the index's own buckets, and
what is new is appended. Every document of the batch then takes the digest's row
in the index as its fate. Only digests, ids and lengths are shuffled, never texts.

Defined results: a null text counts as empty, and all empty texts are equal.
Ids must be whole numbers; a null id loses every tie. Rows that repeat the
staying row's id and length are all reported as kept by ``decide``, since they
are one document; ``keep_one`` lets a single one of them through. An empty table
gives an empty result. Extra columns are ignored by ``decide``, kept by
``keep_one``; a column named like one of the working columns is left as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import ASCII_SPACE, Scratch, filter_by_keys, heavy_safe_join


def _digest(text):
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, ""), 256))


class DigestIndex:
    """Digests seen so far, at ``path``; bucketed and sorted by digest.

    The files outlive the session: opening the same path registers them again.
    A batch that is added a second time under its ``batch`` name finds its own
    rows, so a repeated run gives the same result.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        self.table = f"digest_index_{uuid.uuid4().hex}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(path)
        found = root.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(root, "buckets-*"))
        if found is not None and len(found):
            self.buckets = int(found[0].getPath().getName().split("-")[1])
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.location = f"{path}/buckets-{self.buckets}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_len INT, copies BIGINT, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the groups whose digest isn't there yet."""
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", "keep_len", "copies", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.insertInto(self.table)
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest and length in code points of each row."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        _digest(F.col(text_col)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("len"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One row per digest. Both steps combine before the shuffle, so a hot digest is a few rows by then."""
    each = rows.groupBy("digest", "doc_id", "len").agg(F.count(F.lit(1)).alias("c"))
    best = F.max(F.struct("len", F.bitwise_not("doc_id").alias("not_id"), "c")).alias("best")  # ~id turns the order of ids round
    return (
        each.groupBy("digest")
        .agg(F.sum("c").alias("n"), best)
        .select("digest", "n", F.bitwise_not("best.not_id").alias("keep_id"), F.col("best.len").alias("keep_len"), F.col("best.c").alias("copies"))
    )


def _resolve(docs: DataFrame, index: DigestIndex | None, batch: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    index = index or DigestIndex(spark, f"{scratch.path}/index")
    rows = scratch.write("rows", digests(docs, id_col, text_col))
    groups = scratch.write("groups", _groups(rows))
    index.add(groups, batch)
    fate = index.rows().select("digest", "keep_id", "keep_len", "copies", (F.col("batch") == batch).alias("own"))
    resolved = scratch.write("resolved", groups.select("digest", "n").join(fate.hint("merge"), "digest"))
    scratch.drop("groups")
    out = heavy_safe_join(rows, resolved, "digest", "n", rows.count())
    return out.withColumn("kept", F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")))


def decide(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch-0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fate of every row: doc_id, keep_id, group_size (rows of this batch), kept, text_sha256.

    Without an ``index`` a new one is made in the shared folder.
    """
    out = _resolve(docs, index, batch, id_col, text_col)
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch-0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-out")
    fates = scratch.write("fates", _resolve(docs, index, batch, id_col, text_col))
    key = f"__digest_{uuid.uuid4().hex[:8]}"
    num = f"__id_{uuid.uuid4().hex[:8]}"
    keyed = docs.withColumns({key: _digest(F.col(text_col)), num: F.col(id_col).cast("bigint")})
    named = lambda df: df.select(F.col("doc_id").alias(num), F.col("digest").alias(key)).distinct()
    # a repeated id may stand for a kept and a dropped row of one digest, told apart by length
    mixed = fates.filter("kept AND copies > 1 OR NOT kept AND doc_id <=> keep_id AND own")
    out = filter_by_keys(keyed, named(fates.filter("NOT kept").unionByName(mixed)), [num, key], "left_anti")
    if not mixed.isEmpty():
        again = filter_by_keys(keyed, named(mixed.filter("own")), [num, key], "left_semi")
        longest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.length(F.coalesce(F.col(text_col), F.lit(""))))
        out = out.drop(key, num).unionByName(again.groupBy(num, key).agg(longest.alias("r")).select("r.*"))
        return out
    return out.drop(key, num)
