"""Making the package importable on executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()
#: Rows of a batch that goes to Python, where the session has Spark's own 10,000: of texts, those may be 30 MB and more, several times over.
BATCH_ROWS = 2000
#: Bytes of such a batch, where the session has Spark's own 64 MB: it ends once it is larger, so that rows of any length are bounded.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> SparkSession:
    """``spark``, with this package sent to its executors, once for an application, and batches that suit texts."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    if spark.conf.get(_BYTES, "67108864b") == "67108864b":
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
    if sc.applicationId not in _DONE:
        root = Path(__file__).resolve().parent
        fd, name = tempfile.mkstemp(prefix="corpusloom-", suffix=".zip")  # the driver's copy; Spark serves it to executors
        os.close(fd)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(name)
        atexit.register(Path(name).unlink, missing_ok=True)  # tasks fetch it as long as the application runs
        _DONE.add(sc.applicationId)
    return spark
