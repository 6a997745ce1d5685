"""The folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: The setting by which a query's shuffle files are removed when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only where the setting is absent and all runs on this machine (tests, local
    sessions) a temporary folder is made and set as the session's checkpoint folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, urlparse(found).path, ignore_errors=True)
    return found.rstrip("/")


class Scratch:
    """A folder of tables under the shared folder, for cutting lineage.

    Tables are plain Parquet written by Spark's commit protocol, so a lost
    executor costs a task retry and nothing that was written is lost. Shuffle
    files go as soon as the table that they made is written. What isn't dropped
    by name goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        conf = self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _at_exit(self) -> None:
        parts = urlparse(self.path)
        if parts.scheme in ("", "file"):
            shutil.rmtree(unquote(parts.path), ignore_errors=True)
        else:
            try:
                self._delete(self.path)
            except Exception:  # noqa: BLE001 - the session may have ended before
                pass
