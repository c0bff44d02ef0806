"""Readers into the long relation (series_id, partition_name, step, time, state).

``series_id`` is 0 for a source that holds one run, or a column of it. Steps number a
partition's rows by time, so a file's order doesn't matter; equal times of one partition
keep the first in the order of their states.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..series import ID, STEP, TIME, numbered


def _numbered(df: DataFrame) -> DataFrame:
    """Rows of files, which read the same each time: in spans of time, however many a partition has."""
    return numbered(df, [ID, "partition_name"], [TIME, "state"]).select(ID, "partition_name", STEP, TIME, "state")


def _numbered_at_once(df: DataFrame) -> DataFrame:
    """Where a second read may differ from the first: each partition in one task."""
    w = Window.partitionBy(ID, "partition_name").orderBy(TIME, "state")
    return df.select(ID, "partition_name", (F.row_number().over(w) - 1).cast("long").alias(STEP), TIME, "state")


def read_csv(spark: SparkSession, path: str, time_column: int, state_columns: dict[str, Sequence[int]], header: bool = False) -> DataFrame:
    """Columns by position; a value that isn't a number fails the read."""
    raw = spark.read.option("header", header).option("mode", "FAILFAST").csv(path)
    num = lambda i: F.col(f"`{raw.columns[i]}`").cast("double")
    parts = F.array(*[F.struct(F.lit(n).alias("partition_name"), F.array(*[num(i) for i in cols]).alias("state")) for n, cols in state_columns.items()])
    return _numbered(raw.select(F.lit(0).cast("long").alias(ID), num(time_column).alias(TIME), F.explode(parts).alias("p")).select(ID, "p.partition_name", TIME, "p.state"))


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines {"partition_name", "state", "time"}; a bad line fails the read."""
    raw = spark.read.schema("partition_name string, state array<double>, time double").option("mode", "FAILFAST").json(path)
    return _numbered(raw.select(F.lit(0).cast("long").alias(ID), "partition_name", TIME, "state"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_postgres(spark: SparkSession, url: str, table: str, partitions: Sequence[str], start: float, end: float, **properties: str) -> DataFrame:
    """One task per partition, each a range of times pushed to the database."""
    quoted = ["'" + p.replace("'", "''") + "'" for p in partitions]
    predicates = [f"partition_name = {q} AND time BETWEEN {start!r} AND {end!r}" for q in quoted]
    raw = spark.read.jdbc(url, table, predicates=predicates, properties={"driver": "org.postgresql.Driver", **properties})
    return _numbered_at_once(raw.select(F.lit(0).cast("long").alias(ID), "partition_name", TIME, F.col("state").cast("array<double>").alias("state")))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files with ``time`` and a fixed-size list column per partition, or a folder of
    them. Files are read as binary by Spark's reader, so any store serves, and go on by record
    batches; a file must be under 2 GB. Other columns are skipped."""
    import pyarrow as pa
    import pyarrow.ipc

    def run(batches):
        for content in (c for b in batches for c in b.column(0)):
            with pyarrow.ipc.open_file(content.as_buffer()) as f:
                lists = [c.name for c in f.schema if pa.types.is_fixed_size_list(c.type) and pa.types.is_float64(c.type.value_type)]
                for i in range(f.num_record_batches):
                    b = f.get_batch(i)
                    time = b.column("time").cast(pa.float64())
                    for n in lists:
                        yield pa.RecordBatch.from_arrays([pa.array([n] * len(b), pa.string()), time, b.column(n).cast(pa.list_(pa.float64()))], names=["partition_name", "time", "state"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    return _numbered(raw.mapInArrow(run, "partition_name string, time double, state array<double>").select(F.lit(0).cast("long").alias(ID), "partition_name", TIME, "state"))


def from_dataframe(df: DataFrame, partition: str, columns: Sequence[str] | None = None, time: str | None = "time") -> DataFrame:
    """Columns "0", "1", ... (or those named) of one partition, with a time or numbered. A plan
    that Spark doesn't know to give the same rows each time is numbered in one task."""
    columns = list(columns or sorted((c for c in df.columns if c.isdigit()), key=int))
    state = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    t = F.col(time).cast("double") if time and time in df.columns else F.monotonically_increasing_id().cast("double")
    rows = df.select(F.lit(0).cast("long").alias(ID), F.lit(partition).alias("partition_name"), t.alias(TIME), state.alias("state"))
    return (_numbered if rows._jdf.queryExecution().analyzed().deterministic() else _numbered_at_once)(rows)


def replay_history(df: DataFrame, depth: int) -> DataFrame:
    """Per row, the frame of ``depth`` rows replayed from the oldest: adds ``replay`` and ``at``."""
    rows = F.collect_list("state").over(Window.partitionBy(ID, "partition_name").orderBy(STEP).rowsBetween(1 - depth, 0))
    return df.withColumn("__h", rows).select(*df.columns, F.posexplode("__h").alias("at", "replay"))


#: Formats of files, wherever they lie; an object store's path (s3a://...) goes to any of them.
FORMATS: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "json_log": read_json_log, "arrow": read_arrow, "parquet": read_parquet}
SOURCES: dict[str, Callable[..., DataFrame]] = {**FORMATS, "postgres": read_postgres}


def register_source(name: str, read: Callable[..., DataFrame]) -> None:
    SOURCES[name] = read


def load(spark: SparkSession, kind: str, **fields) -> DataFrame:
    if kind == "s3":
        kind, fields["path"] = fields.pop("format"), f"s3a://{fields.pop('bucket')}/{fields.pop('key')}"
    if kind not in SOURCES:
        raise ValueError(f"no source {kind!r}")
    return SOURCES[kind](spark, **fields)
