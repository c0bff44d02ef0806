"""The series relation: (series_id, step, time, value columns...).

One row is one committed state of one series. ``step`` counts from 0 in the order of time and
a tie-break; windows are partitioned by series and ordered by step, so series run in parallel
and a window reads only its own series. Values stay scalar columns inside the engine; vectors
appear as arrays only where a caller asks for them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, STEP, TIME = "series_id", "step", "time"


def seconds(ts: str) -> Column:
    """Unix seconds of a TIMESTAMP_NTZ column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def by_step() -> WindowSpec:
    return Window.partitionBy(ID).orderBy(STEP)


def frame(depth: int) -> WindowSpec:
    """The latest row and ``depth`` before it."""
    return by_step().rowsBetween(-depth, 0)


#: Rows that a task should number or roll over at once, where a series may be cut.
CHUNK_ROWS = 1_000_000
#: Rows of a span where all that is done with it is to number it.
SPAN_ROWS = 250_000
#: Bytes of the files read, for each task that sorts series.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, *by: str, by_range: bool = False) -> DataFrame:
    """Rows dealt out by ``by``, over a number of tasks that follows the bytes of the files read,
    so that what one task sorts stays as it is while tables grow. Where that is no more than the
    cores, or the size is not known, Spark deals them out."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    tasks = -(-sum(s for s in sizes if s < 1 << 60) // TASK_BYTES)  # an RDD counts as the largest long
    if tasks > df.sparkSession.sparkContext.defaultParallelism:
        return df.repartitionByRange(tasks, *by) if by_range else df.repartition(tasks, *by)
    return df.repartitionByRange(*by) if by_range else df


def _picked(df: DataFrame, series: Column, order: Sequence[str], time: Column, values: dict[str, Column]) -> DataFrame:
    return df.select(series.alias(ID), time.cast("double").alias(TIME), *[v.cast("double").alias(k) for k, v in values.items()], *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])


def to_series(df: DataFrame, series: Column, order: Sequence[str], time: Column, values: dict[str, Column]) -> DataFrame:
    """Number the rows of each series from 0 by ``order``, which must be unique in a series."""
    w = Window.partitionBy(ID).orderBy(*[f"__o{i}" for i in range(len(order))])
    return spread(_picked(df, series, order, time, values), ID).select(ID, (F.row_number().over(w) - 1).cast("long").alias(STEP), TIME, *values)


def to_long_series(df: DataFrame, series: Column, order: Sequence[str], time: Column, values: dict[str, Column], rows: int = CHUNK_ROWS) -> DataFrame:
    """As ``to_series``, where one series may hold most rows; ``time`` must not fall along ``order``."""
    return numbered(_picked(df, series, order, time, values), [ID], [f"__o{i}" for i in range(len(order))], rows).select(ID, STEP, TIME, *values)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = SPAN_ROWS) -> DataFrame:
    """Adds ``step``, the number of a row from 0 along ``order`` among those of equal ``by``, where
    ``time`` does not fall along ``order``.

    A series of more than ``rows`` rows is cut into even spans of time, some ``rows`` rows each
    on average; a span's rows are numbered in a task of their own, from the count of those
    before it. Rows of one time stay together. The input is read three times and must be the
    same each time; besides the rows only slim counts are shuffled, and those of spans, some two
    for each ``rows`` rows at most, are broadcast.
    """
    n = F.count(F.lit(1))
    named = lambda p: [F.col(c).alias(f"{p}{i}") for i, c in enumerate(by)]
    same = lambda p: reduce(and_, [F.col(c).eqNullSafe(F.col(f"{p}{i}")) for i, c in enumerate(by)])
    giant = df.groupBy(*named("__g")).agg(F.min(TIME).alias("__t0"), ((F.max(TIME) - F.min(TIME)) / F.ceil(n / rows)).alias("__w"), n.alias("__n"))
    cut = df.join(F.broadcast(giant.where(F.col("__n") > rows)), same("__g"), "left")
    span = F.when(F.col("__w") > 0, F.coalesce(F.floor((F.col(TIME) - F.col("__t0")) / F.col("__w")), F.lit(0))).otherwise(0)
    cut = cut.select(*df.columns, "__w", span.cast("long").alias("__k"))
    counts = cut.where(F.col("__w") > 0).groupBy(*named("__i"), F.col("__k").alias("__j")).agg(n.alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*[f"__i{i}" for i in range(len(by))]).orderBy("__j").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[f"__i{i}" for i in range(len(by))], "__j", before.alias("__b"))
    at = F.row_number().over(Window.partitionBy(*by, "__k").orderBy(*order))
    placed = spread(cut.drop("__w"), *by, "__k").withColumn("__at", at).join(F.broadcast(counts), same("__i") & (F.col("__k") == F.col("__j")), "left")
    return placed.select(*df.columns, (F.coalesce("__b", F.lit(0)) + F.col("__at") - 1).cast("long").alias(STEP))


def in_chunks(df: DataFrame, depth: int, operator: Callable[[DataFrame], DataFrame], rows: int = CHUNK_ROWS) -> DataFrame:
    """``operator(df)``, for one that reads at most ``depth`` rows back, on series of any length.

    A series is cut into chunks of ``rows`` steps; the last ``depth`` of a chunk go before the
    next one too, and what they give there is left out. The operator sees a chunk as a series
    of its own, whose steps start where they did. Steps must count from 0 without gaps.
    """
    if depth > rows:
        raise ValueError("a chunk must be longer than the frame")
    chunk = F.floor(F.col(STEP) / rows)
    own = F.array(chunk)
    cut = df.withColumn("__chunk", F.explode(F.when(F.col(STEP) % rows >= rows - depth, F.array(chunk, chunk + 1)).otherwise(own) if depth else own))
    out = operator(cut.withColumn(ID, F.struct(F.col(ID), F.col("__chunk"))).drop("__chunk"))
    return out.where(F.col(f"{ID}.__chunk") == chunk).withColumn(ID, F.col(f"{ID}.{ID}"))


def folded(df: DataFrame, read: Sequence[str], start: Callable[[object], Callable[..., tuple]], out: dict[str, T.DataType]) -> DataFrame:
    """Adds columns that a fold of each series gives, step by step: ``start(series id)`` makes
    a function from the step and the columns ``read`` to a row's values of ``out``.

    A task streams its series in order and holds one fold, so neither the number of series nor
    a series' length costs memory. A number that is null is read as NaN.
    """
    import pyarrow as pa

    def run(batches):
        last, fold = (), None
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            ids, rows = b.column(at[ID]).to_pylist(), []
            for key, *values in zip(ids, *[b.column(at[c]).to_numpy(zero_copy_only=False).tolist() for c in (STEP, *read)]):
                if last != (key,):
                    last, fold = (key,), start(key)
                rows.append(fold(*values))
            made = [pa.array(list(v)) for v in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *out])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in out.items()]])
    return df.repartition(ID).sortWithinPartitions(ID, STEP).mapInArrow(run, schema)


def values_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ID, STEP, TIME)]


def to_long(df: DataFrame, blocks: dict[str, Sequence[str]]) -> DataFrame:
    """Wide to (series_id, partition_name, step, time, state), a block of columns a partition."""
    parts = F.array(*[F.struct(F.lit(n).alias("partition_name"), F.array(*[F.col(c) for c in cs]).alias("state")) for n, cs in blocks.items()])
    return df.select(ID, STEP, TIME, F.explode(parts).alias("p")).select(ID, "p.partition_name", STEP, TIME, "p.state")


def to_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long to one array column a partition; a partition without a row at a step is null."""
    return long.groupBy(ID, STEP, TIME).pivot("partition_name", list(names)).agg(F.first("state"))


def state_columns(df: DataFrame, width: int, state: str = "state") -> DataFrame:
    """A state array as columns named "0", "1", ... after the time."""
    return df.select(ID, STEP, TIME, *[F.get(state, F.lit(i)).alias(str(i)) for i in range(width)])


def validate_aligned(long: DataFrame) -> DataFrame:
    """The input, or an error on reading if a step's partitions differ in time or number."""
    w = Window.partitionBy(ID, STEP)
    n = long.select("partition_name").distinct().count()
    checked = long.withColumn("__ok", (F.min(TIME).over(w) == F.max(TIME).over(w)) & (F.count(F.lit(1)).over(w) == n))
    return checked.where(F.coalesce(F.assert_true("__ok", F.lit("partitions are not aligned")).isNull(), F.lit(True))).drop("__ok")


def replace_partition(long: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """Rows of a partition replaced, or added if there were none."""
    return long.where(F.col("partition_name") != name).unionByName(rows.withColumn("partition_name", F.lit(name)).select(long.columns))


class DataRef:
    """A column selector: a partition, value indices (all, if none) and a range of steps."""

    def __init__(self, partition: str, indices: Sequence[int] | None = None, steps: tuple[int, int] | None = None, is_time: bool = False):
        self.partition, self.indices, self.steps, self.is_time = partition, indices, steps, is_time

    def names(self, width: int) -> list[str]:
        if self.is_time:
            return [TIME]
        return [f"{self.partition} {i}" for i in (range(width) if self.indices is None else self.indices)]

    def read(self, long: DataFrame, width: int) -> DataFrame:
        rows = long.where(F.col("partition_name") == self.partition)
        if self.steps:
            rows = rows.where((F.col(STEP) >= self.steps[0]) & (F.col(STEP) < self.steps[1]))
        if self.is_time:
            return rows.select(ID, STEP, TIME)
        picks = range(width) if self.indices is None else self.indices
        return rows.select(ID, STEP, TIME, *[F.element_at("state", i + 1).alias(f"{self.partition} {i}") for i in picks])

    def row(self, long: DataFrame, width: int, step: int) -> DataFrame:
        """The row of each series at a step, or an error on reading for one that is shorter."""
        rows = DataRef(self.partition, self.indices, None, self.is_time).read(long, width)
        last = rows.groupBy(F.col(ID).alias("__i")).agg(F.max(STEP).alias("__last"))
        short = F.raise_error(F.concat(F.lit(f"step {step} is beyond the last, "), F.col("__last").cast("string")))
        last = last.select("__i", F.when((F.col("__last") >= step) & F.lit(step >= 0), F.lit(step)).otherwise(short).cast("long").alias("__at"))
        return last.join(rows, F.col(ID).eqNullSafe(F.col("__i")) & (F.col(STEP) == F.col("__at"))).drop("__i", "__at", "__last")


#: Elements of an embedding.
EMBEDDING = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(read_table(spark, sf_dir, "events"), F.col("user_id"), ["ts", "event_id"], seconds("ts"), {"value": F.col("value")})


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(read_table(spark, sf_dir, "events"), F.col("event_type"), ["ts", "event_id"], seconds("ts"), {"value": F.col("value")})


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(read_table(spark, sf_dir, "orders"), F.col("o_custkey"), ["o_orderdate", "o_orderkey"], seconds("o_orderdate"), {"price": F.col("o_totalprice")})


def lineitem_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount")}
    return to_series(read_table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], seconds("l_shipdate"), cols)


def whole_embeddings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return to_series(df, F.col("label"), ["vec_id"], F.col("vec_id"), {f"e{i}": F.get("embedding", F.lit(i)) for i in range(EMBEDDING)})


def embeddings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return to_series(df, F.col("label"), ["vec_id"], F.col("vec_id"), {f"e{i}": F.element_at("embedding", i + 1) for i in range(4)})
