"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import discard, written


def _state(e: DataFrame) -> tuple:
    """A set's size and two sums of 64-bit hashes over it, in full, so that two states agree
    only where the sets do."""
    whole = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    return tuple(e.agg(F.count(F.lit(1)), whole("u", "v"), whole(F.lit(1), "v", "u")).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b) but the roots, the least of each
    component. A round takes, per node, the least neighbour, which is pre-aggregated, and
    joins it back, a join that adaptive execution splits at hubs; rounds grow with the
    logarithm of the longest path. Nulls link nothing; repeated edges count once."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large, e)
        before, state, e = state, _state(new), new
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
