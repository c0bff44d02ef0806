"""Group discovery and grouped aggregation over composite numeric keys.

Values and keys are aligned columns of a series: value k of a row belongs to the group named
by the k-th column of every key list. A row holds the places of its groups, and a frame is read
before the known groups are exploded: only one shuffle by series is needed, a task sorts rows of
steps and none of the dense grid, and the grid needs no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..series import ID, STEP, TIME, by_step, frame
from .kernels import Constant, Instantaneous, Kernel
from .rolling import UNROLLED

#: Groups are parameters of a plan; beyond this many they must be named by the caller.
MOST_GROUPS = 100_000


def rounded(c: Column | str, precision: int) -> Column:
    return F.bround(F.col(c) if isinstance(c, str) else c, precision)


def entries(values: Sequence[str], keys: Sequence[Sequence[str]], precision: int) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("index"), F.array(*[rounded(ks[k], precision) for ks in keys]).alias("key"), F.col(v).alias("x")) for k, v in enumerate(values)])


def entry_rows(df: DataFrame, values: Sequence[str], keys: Sequence[Sequence[str]], precision: int) -> DataFrame:
    """Rows (series_id, step, index, key, x), one a value: for sums over all steps, which need
    neither the dense grid nor the groups beforehand."""
    return df.select(ID, STEP, F.explode(entries(values, keys, precision)).alias("e")).select(ID, STEP, "e.index", "e.key", "e.x")


def discover_groups(df: DataFrame, keys: Sequence[Sequence[str]], precision: int) -> DataFrame:
    """Distinct key tuples, numbered by first occurrence, value index before time."""
    rows = entry_rows(df, keys[0], keys, precision)
    first = rows.groupBy("key").agg(F.min(F.struct(F.col("index").alias("i"), F.col(STEP).alias("s"), F.col(ID).alias("d"))).alias("at"))
    # one row a group: the distinct tuples are few by the model, and counted before use
    return first.select("key", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("group_idx"))


def group_list(df: DataFrame, keys: Sequence[Sequence[str]], precision: int) -> list[list[float]]:
    rows = discover_groups(df, keys, precision).limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups; name the accepted ones")
    return [list(r.key) for r in sorted(rows, key=lambda r: r.group_idx)]


def _weighted(aggregation: str | Callable[[Column], Column], pairs: Column, decimals: int | None) -> Column:
    """Of an array of (w, x): an aggregation by name, or a function of the array. Weights that are
    decimals are summed as such: 0.09 six times is 0.54, not the double below it."""
    if callable(aggregation):
        return aggregation(pairs)
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + f(p))
    if decimals is None:
        n = total(lambda p: p["w"])
    else:
        kind = f"decimal(30,{decimals})"
        n = F.aggregate(pairs, F.lit(0).cast(kind), lambda a, p: (a + p["w"].cast(kind)).cast(kind)).cast("double")
    products = F.transform(pairs, lambda p: p["w"] * p["x"])
    return {
        "count": n, "sum": total(lambda p: p["w"] * p["x"]), "mean": ieee.divide(total(lambda p: p["w"] * p["x"]), n), "max": F.array_max(products), "min": F.array_min(products),
    }[aggregation]


def _of_columns(xs: Sequence[Column]) -> dict[str, Column]:
    """Of columns that are null outside of a group."""
    add = lambda ys: sum(ys, F.lit(0.0))
    least, most = (f(*xs) if len(xs) > 1 else xs[0] for f in (F.least, F.greatest))
    return {"n": add(F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in xs), "s": add(F.coalesce(x, F.lit(0.0)) for x in xs), "hi": most, "lo": least}


def _of_array(xs: Column) -> dict[str, Column]:
    return {"n": F.size(xs).cast("double"), "s": F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), "hi": F.array_max(xs), "lo": F.array_min(xs)}


def _plain(df: DataFrame, aggregation: str, own: dict[str, Column], seen: dict[str, Column], instantaneous: bool) -> DataFrame:
    """Adds __value, of a group in the latest row and in its frame; null without a value. Count,
    sum and extremes are columns of their own, so that each is computed once."""
    df = df.withColumns({f"__{k}": c for k, c in (own if instantaneous else seen).items()} | {"__seen": seen["n"]})
    n, s, hi, lo = (F.col(f"__{k}") for k in ("n", "s", "hi", "lo"))
    if instantaneous:
        past = F.col("__seen") - n  # rows with weight 0
        hi = F.when(past > 0, F.greatest(F.lit(0.0), F.coalesce(hi, F.lit(0.0)))).otherwise(hi)
        lo = F.when(past > 0, F.least(F.lit(0.0), F.coalesce(lo, F.lit(0.0)))).otherwise(lo)
    value = {"count": n, "sum": s, "mean": F.when(n > 0, ieee.divide(s, n)), "max": hi, "min": lo}[aggregation]
    return df.withColumn("__value", F.when(F.col("__seen") > 0, value))


def grouped_aggregation(
    df: DataFrame, values: Sequence[str], keys: Sequence[Sequence[str]], aggregation: str | Callable[[Column], Column], *, precision: int = 0, depth: int = 0,
    groups: Sequence[Sequence[float]] | None = None, default: float = 0.0, instantaneous: bool = False, kernel: Kernel | None = None,
) -> DataFrame:
    """Rows (series_id, step, group_idx, key, value) for each step and group.

    Aggregations: count (sum of weights), sum, mean, min, max over the latest row and ``depth``
    rows before it, or a function from an array of (w, x) to a Column. Weights are a kernel's,
    with its parameters; without one they are constant, or 1 now and 0 before
    (``instantaneous``). Step 0 has the default, and so has a group without a value in the
    frame. A frame of constant weights reads lagged columns where it is short, in generated
    code; of other weights, and beyond, it is gathered, ``depth`` + 1 rows at most.
    """
    instantaneous = instantaneous or isinstance(kernel, Instantaneous)
    if kernel is not None and (kernel.constant or instantaneous):
        kernel = None
    groups = [list(map(float, g)) for g in (groups if groups is not None else group_list(df, keys, precision))]
    if not groups:
        return df.select(ID, STEP, F.lit(0).alias("group_idx"), F.array().cast("array<double>").alias("key"), F.lit(default).alias("value")).limit(0)
    first: dict[tuple, int] = {}  # a group's place, which one that is named again shares
    places = [first.setdefault(tuple("nan" if x != x else x for x in g), i + 1) for i, g in enumerate(groups)]
    listed = F.array(*[F.struct(F.lit(i).alias("group_idx"), F.array(*[F.lit(x) for x in g]).alias("key"), F.lit(p).alias("at")) for i, (g, p) in enumerate(zip(groups, places, strict=True))])
    n = len(values)
    place = lambda k: F.array_position(F.transform(listed, lambda g: g["key"]), F.array(*[rounded(ks[k], precision).cast("double") for ks in keys])).cast("int")
    rows = df.select(ID, STEP, TIME, *[place(k).alias(f"__g{k}") for k in range(n)], *[F.col(v).alias(f"__x{k}") for k, v in enumerate(values)])
    grid = lambda of: of.select("*", F.explode(listed).alias("g")).select("*", "g.*")
    shown = lambda of: of.select(ID, STEP, "group_idx", "key", F.when(F.col(STEP) >= 1, F.coalesce("__value", F.lit(default))).otherwise(default).alias("value"))
    if kernel is None and not callable(aggregation) and depth <= UNROLLED:
        lags = [F.lag(f"__{c}{k}", i).over(by_step()).alias(f"__{c}{k}_{i}") for c in "gx" for k in range(n) for i in range(1, depth + 1)]
        name = lambda c, k, i: f"__{c}{k}_{i}" if i else f"__{c}{k}"
        back = [[F.when(F.col(name("g", k, i)) == F.col("at"), F.col(name("x", k, i))) for k in range(n)] for i in range(depth, -1, -1)]
        return shown(_plain(grid(rows.drop(TIME).select("*", *lags)), aggregation, _of_columns(back[-1]), _of_columns(sum(back, [])), instantaneous))
    known = kernel or (Instantaneous() if instantaneous else Constant())
    framed = rows.withColumn("__h", F.collect_list(F.struct(STEP, *rows.columns[2:])).over(frame(depth)))
    state = lambda at: [at(f"__x{k}") for k in range(n)]
    weight = lambda r: known.weight(F.col(TIME), r[TIME], state(F.col), state(lambda c: r[c])).cast("double")
    entry = lambda r, k, w: F.struct(r[f"__g{k}"].alias("at"), r[STEP].alias("step"), w.alias("w"), r[f"__x{k}"].alias("x"))
    framed = framed.select(ID, STEP, F.flatten(F.transform("__h", lambda r: F.array(*[entry(r, k, weight(r)) for k in range(n)]))).alias("__e"))
    framed = grid(framed).withColumn("__e", F.filter("__e", lambda e: e["at"] == F.col("at")))
    if kernel is None and not callable(aggregation):
        xs = lambda ok: F.transform(F.filter("__e", lambda e: e["x"].isNotNull() & ok(e)), lambda e: e["x"])
        framed = framed.withColumns({"__now": xs(lambda e: e["step"] == F.col(STEP)), "__all": xs(lambda e: F.lit(True))})
        return shown(_plain(framed, aggregation, _of_array(F.col("__now")), _of_array(F.col("__all")), instantaneous))
    framed = framed.withColumn("__p", F.transform("__e", lambda e: F.struct(e["w"].alias("w"), e["x"].alias("x"))))
    return shown(framed.withColumn("__value", F.when(F.size("__p") > 0, _weighted(aggregation, F.col("__p"), known.decimals))))
