"""Scratch storage and small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The most that a side may have for an explicit broadcast.
BROADCAST_BYTES = 32 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A session on one machine, as in tests, may do
    without: there a local folder serves. The setting itself is never written."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tidewheel-scratch"
    return base.rstrip("/") + "/tidewheel"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back with the same schema."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "scratch", None)
        if path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of long texts must stay small; only the default is lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at most about ``most`` bytes; a batch that is larger is cut by rows."""
    held, size = [], 0
    for b in batches:
        pieces = max(1, -(-b.nbytes // most))
        step = max(1, -(-b.num_rows // pieces))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            if held and size + part.nbytes > most:
                yield held
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def ascii_lower(c):
    """Lower-case A-Z only; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
