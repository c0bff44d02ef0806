"""Sharding by extendible hashing, in DataFrame functions alone.

The directory is indexed by prefixes of a key's 60-bit hash. A bucket holds the rows of one
prefix; a bucket over its byte limit splits on the next bit, and only such buckets split, so
light prefixes keep short names. Each round sums the bytes of the oversized buckets' children
``step`` bits further at once, a bounded fan-out per bucket, and the directory is a table,
never a driver-side list.

Rows with equal hashes cannot be told apart by more bits of it, so after 60 bits the rows of
a key go on with bits of a hash of the whole row, and then of the row's number in the written
table. A bucket of one row over the limit stays, marked ``fits`` false.

Defined results: a null key hashes as the empty string; null text is 0 bytes; repeated rows
each go to one shard; an empty table gives an empty result. Input columns with the name of
an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import discard, written

BITS = 60


def hash60(c: Column) -> Column:
    """First 60 bits of the MD5 of a value's string."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(depth: Column) -> Column:
    """The first ``depth`` of the 180 bits h0, h1, h2, as bits in a string."""
    bits = F.concat(*[F.lpad(F.bin(f"h{i}"), BITS, "0") for i in range(3)])
    return F.substring(bits, F.lit(1), depth)


def extendible(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", step: int = 6) -> tuple[DataFrame, DataFrame]:
    """The rows with shard (hash prefix), depth and n_bytes, and the directory of shards."""
    made = ("shard", "depth", "n_bytes", "h0", "h1", "h2", "bits", "n_rows", "shard_bytes", "fits")
    base = docs.select(
        *[c for c in docs.columns if c not in made and c != text],
        F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        hash60(F.col(key)).alias("h0"),
        hash60(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(text).cast("string"))).alias("h1"),
        hash60(F.monotonically_increasing_id()).alias("h2"),  # fixed by the write below
    )
    rows = written(base, "shard-rows")
    leaves, open_rows, depth = None, rows, 0
    while True:
        # sums at each depth of this round, from one pre-aggregation at the deepest
        deep = min(depth + step, 3 * BITS)
        sums = written(
            open_rows.groupBy(prefix(F.lit(deep)).alias("bits")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "shard-sums"
        )
        levels = sums.select("b", "n", "bits", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"))
        every = levels.groupBy("depth", F.substring("bits", F.lit(1), F.col("depth")).alias("bits")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        small = (F.col("b") <= limit) | (F.col("n") == 1) | (F.col("depth") == 3 * BITS)
        # a leaf is the first small prefix of its path
        parent = every.where(~small & (F.col("depth") < deep)).select(F.col("bits").alias("p"), F.col("depth").alias("pd"))
        tops = every.where(small & (F.col("depth") == depth))
        below = every.where(F.col("depth") > depth).join(
            parent, (F.expr(f"substring(bits, 1, depth - 1)") == F.col("p")) & (F.col("depth") - 1 == F.col("pd")), "leftsemi"
        )
        found = written(tops.unionByName(below.where(small)).select("bits", "depth", "b", "n"), "shard-leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        rest = written(below.where(~small & (F.col("depth") == deep)).select("bits"), "shard-open")
        discard(sums)
        if rest.isEmpty():
            break
        open_rows = open_rows.join(rest, prefix(F.lit(deep)) == F.col("bits"), "leftsemi")
        depth = deep
    directory = leaves.select(
        F.col("bits").alias("shard"), "depth", F.col("b").alias("shard_bytes"), F.col("n").alias("n_rows"), (F.col("b") <= limit).alias("fits")
    )
    # each row meets the one leaf on its path: an equi-join per depth that occurs
    depths = [r.depth for r in directory.select("depth").distinct().collect()]  # at most 181 numbers
    paths = rows.select("*", F.explode(F.array(*[F.lit(d) for d in sorted(depths)] or [F.lit(0)])).alias("__d"))
    out = paths.join(directory, (F.col("__d") == F.col("depth")) & (prefix(F.col("__d")) == F.col("shard")))
    return out.drop("__d", "h0", "h1", "h2"), directory


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard. Rows of a shard meet in one task, which the byte limit bounds."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)
