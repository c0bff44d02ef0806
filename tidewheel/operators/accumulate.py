"""Running and discounted sums, collections, switches, lagged reads and sampling of steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import ID, STEP, TIME, by_step, folded


def lagged(df: DataFrame, picks: dict[str, str], n: int = 1) -> DataFrame:
    """Adds the committed value n steps back of each picked column (null before the first)."""
    return df.select("*", *[F.lag(c, n).over(by_step()).alias(out) for out, c in picks.items()])


def first_difference(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select("*", *[(F.col(c) - F.lag(c).over(by_step())).alias(f"{c}_diff") for c in cols])


def cumulative(df: DataFrame, cols: Sequence[str], init: float = 0.0, rows: int | None = None) -> DataFrame:
    """Adds <col>_cum: the initial value and every datum from step 1 on. With ``rows`` a series
    is summed in blocks of so many steps, for series too long for a task, and a block's rows
    add the sum of the blocks before it."""
    data = {c: F.when(F.col(STEP) >= 1, F.col(c)) for c in cols}
    zero = F.lit(0.0)
    if rows is None:
        w = by_step().rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[(F.lit(init) + F.coalesce(F.sum(x).over(w), zero)).alias(f"{c}_cum") for c, x in data.items()])
    cut = df.withColumn("__b", F.floor(F.col(STEP) / rows))
    w = Window.partitionBy(ID, "__b").orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.coalesce(F.sum(x).over(w), zero).alias(f"__s_{c}") for c, x in data.items()])
    ends = cut.groupBy(F.col(ID).alias("__i"), F.col("__b").alias("__k")).agg(*[F.sum(x).alias(f"__e_{c}") for c, x in data.items()])
    prior = Window.partitionBy("__i").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__i", "__k", *[F.coalesce(F.sum(f"__e_{c}").over(prior), zero).alias(f"__p_{c}") for c in data])
    both = local.join(ends, F.col(ID).eqNullSafe(F.col("__i")) & (F.col("__b") == F.col("__k")))
    return both.select(*df.columns, *[(F.lit(init) + F.col(f"__p_{c}") + F.col(f"__s_{c}")).alias(f"{c}_cum") for c in data])


def discounted_cumulative(df: DataFrame, col: str, discount: float) -> DataFrame:
    """Adds <col>_dis: y_n = x_n + discount * y_(n-1), zero at step 0.

    A linear scan in two levels. In a chunk of steps, short enough that the powers stay in
    range, it is a prefix sum of x over a power of the discount; the chunks' ends, one row
    each, carry over by a fold.
    """
    if discount == 0:
        return df.withColumn(f"{col}_dis", F.when(F.col(STEP) >= 1, F.col(col)).otherwise(0.0))
    decades = abs(math.log10(abs(discount)))
    chunk = max(1, min(512, int(200 / decades))) if decades else 512
    x = F.when(F.col(STEP) >= 1, F.col(col)).otherwise(0.0)
    place = F.col(STEP) % chunk
    w = Window.partitionBy(ID, "__c").orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("__c", F.floor(F.col(STEP) / chunk)).withColumn(
        "__l", F.sum(x * F.pow(F.lit(discount), -place)).over(w) * F.pow(F.lit(discount), place)
    )
    # the carry of a chunk folds the ends of those before it: one value per chunk
    ends = local.groupBy(ID, "__c").agg(F.max_by("__l", STEP).alias("__e"))
    before = F.collect_list("__e").over(Window.partitionBy(ID).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    carry = F.aggregate(before, F.lit(0.0), lambda a, e: a * F.lit(discount**chunk) + e)
    joined = local.join(ends.select(F.col(ID).alias("__i"), F.col("__c").alias("__k"), carry.alias("__y")), (F.col(ID).eqNullSafe(F.col("__i"))) & (F.col("__c") == F.col("__k")))
    return joined.select(*df.columns, (F.col("__l") + F.pow(F.lit(discount), place + 1) * F.col("__y")).alias(f"{col}_dis"))


def running_top(df: DataFrame, key: str, values: Sequence[str], k: int) -> DataFrame:
    """Adds ``top``: the k largest (key, values) so far from step 1 on, ties by earlier step.

    A row keeps k entries; blocks of steps are first cut to their own k, so a row reads the
    running best of earlier blocks and its own block's rows, never the whole series.
    """
    block = max(64, 4 * k)
    entry = F.struct((-F.col(key)).alias("neg"), F.col(STEP).alias("at"), F.col(key).alias("key"), *values)
    cut = lambda a: F.slice(F.array_sort(a), 1, k)
    base = df.withColumn("__b", F.floor(F.col(STEP) / block)).withColumn("__t", F.when(F.col(STEP) >= 1, entry))
    mine = cut(F.collect_list("__t").over(Window.partitionBy(ID, "__b").orderBy(STEP).rowsBetween(Window.unboundedPreceding, 0)))
    base = base.withColumn("__m", mine)
    ends = base.groupBy(ID, "__b").agg(F.max_by("__m", STEP).alias("__e"))
    prior = F.collect_list("__e").over(Window.partitionBy(ID).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(ID).alias("__i"), F.col("__b").alias("__k"), cut(F.flatten(prior)).alias("__p"))
    out = base.join(ends, F.col(ID).eqNullSafe(F.col("__i")) & (F.col("__b") == F.col("__k")))
    return out.select(*df.columns, F.transform(cut(F.concat("__p", "__m")), lambda e: F.struct(e["key"], *[e[v] for v in values])).alias("top"))


def event_switch(event: Column, branches: dict[float, Column], default: Column) -> Column:
    """The branch of the event's value, else the default."""
    out = None
    for value, branch in branches.items():
        out = F.when(event == value, branch) if out is None else out.when(event == value, branch)
    return out.otherwise(default)


def every_n(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col(STEP) % n == 0)


def only_partitions(long: DataFrame, names: Sequence[str]) -> DataFrame:
    return long.where(F.col("partition_name").isin(*names))


def until_time(df: DataFrame, most: float) -> DataFrame:
    """Rows up to and with the first at or beyond a time."""
    return df.withColumn("__p", F.lag(TIME).over(by_step())).where(F.col("__p").isNull() | (F.col("__p") < most)).drop("__p")


def fifo(df: DataFrame, slots: int, push: str, pop: str, empty: float = -1.0) -> DataFrame:
    """Adds ``queue``: slot 0 the last value popped, then ``slots`` places. A row whose ``pop``
    is not zero takes the first non-empty place, then a row whose ``push`` isn't the empty
    value fills the first empty one; a full queue is an error. Rows of a series stay ordered
    in one task, as each state is made from the one before."""

    def start(series):
        q = [empty] * (slots + 1)

        def fold(step, value, take):
            if step >= 1:
                if take:
                    full = next((i for i in range(1, slots + 1) if q[i] != empty), None)
                    if full:
                        q[0], q[full] = q[full], empty
                if value != empty:
                    free = next((i for i in range(1, slots + 1) if q[i] == empty), None)
                    if free is None:
                        raise ValueError("the collection is full")
                    q[free] = value
            return (list(q),)

        return fold

    return folded(df, [push, pop], start, {"queue": T.ArrayType(T.DoubleType())})


def weighted_resample(df: DataFrame, log_weights: Sequence[str], values: Sequence[str], depth: int, discount: float, draw: Column) -> DataFrame:
    """Adds ``resampled``: a value of the frame's rows and columns, drawn with probability
    proportional to exp(log weight) * discount^(rows back), by a uniform ``draw``."""
    rows = F.reverse(F.collect_list(F.struct(*dict.fromkeys([*log_weights, *values]))).over(by_step().rowsBetween(-depth, 0)))
    flat = F.flatten(
        F.transform(
            rows, lambda r, i: F.array(*[F.struct((r[w] + i * math.log(discount) if discount > 0 else r[w]).alias("l"), r[v].alias("x")) for w, v in zip(log_weights, values, strict=True)])
        )
    )
    out = df.withColumn("__f", flat)
    top = F.array_max(F.transform("__f", lambda e: e["l"]))
    out = out.withColumn("__m", top).withColumn("__t", F.aggregate("__f", F.lit(0.0), lambda a, e: a + F.exp(e["l"] - F.col("__m"))))
    picked = F.aggregate(
        "__f",
        F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("x")),
        lambda a, e: F.struct(
            (a["c"] + F.exp(e["l"] - F.col("__m"))).alias("c"),
            F.when(a["x"].isNull() & (a["c"] + F.exp(e["l"] - F.col("__m")) >= draw * F.col("__t")), e["x"]).otherwise(a["x"]).alias("x"),
        ),
        lambda a: a["x"],
    )
    return out.select(*df.columns, picked.alias("resampled"))
