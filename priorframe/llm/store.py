"""Intermediate tables in the folder that the cluster shares, and small helpers.

Every multi-pass operator cuts its lineage by writing a Parquet table under
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a
recomputation of the whole operator.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its written size is at most this.
BROADCAST_BYTES = 8 << 20
#: Rows that one Arrow batch hands to a Python worker; texts can be long.
ARROW_ROWS = 512


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see; only a local master may fall back to a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="priorframe-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def local_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small driver-made table as one JSON literal, parsed by the JVM."""
    text = F.lit(json.dumps(rows))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(text, f"array<struct<{ddl}>>")))


class Workspace:
    """Tables of one operator call, each under its own fresh path."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, step: str) -> DataFrame:
        """Write df and return the reader of what was written."""
        self.made += 1
        path = f"{self.base}/{self.made:02d}-{step}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def bytes(self, kept: DataFrame) -> int:
        fs, p = self._fs(kept.kept_at)
        return fs.getContentSummary(p).getLength()

    def sized(self, kept: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
        """kept with a broadcast hint if its written size is within the limit; else left to a shuffled join."""
        return F.broadcast(kept) if self.bytes(kept) <= limit else kept.hint("shuffle_hash")

    def drop(self, *kept: DataFrame) -> None:
        """Free tables that no later step reads."""
        for x in kept:
            fs, p = self._fs(x.kept_at)
            fs.delete(p, True)
