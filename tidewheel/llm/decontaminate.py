"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

A window is ``size`` consecutive words of an item, or the whole item when it is shorter. Its
tokens are its shingles of ``token`` words, ordered by rarity: by their count over all
documents. A document holds a window only if it holds all its tokens, so at full containment
the necessary prefix is one token, the rarest. The join is on that token; its places in the
document and in the window give the one place where the window would start, which must lie
within the document (positional and length bound), and there every token of the window must
stand, which is exact containment.

One scan of the documents finds all places of the benchmark's shingles: a word of the
document meets the shingles whose rarest word in the benchmark it is, and the words around it
are compared. Only places found are written and shuffled. That side of the join is broadcast
behind a check of its size. Beyond the bound, a row for each word, with the hash of the
shingle that begins there, is shuffled to the shingles, and what meets is compared with the
words of its document.

Defined results: null text has no words and no hits; null or empty items have no windows;
an item id that repeats counts once, with the windows of all its rows; each row of ``docs``
is a document with counts of its own, also where its key is null or repeats; empty tables
give an empty result or no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import BROADCAST_BYTES, ascii_lower, discard, written

#: Characters that separate words, after A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text. Gaps are maximal, so only the ends of the split can be empty."""
    parts = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP, -1)
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(F.lit(0), last - first + 1))


def windows(items: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Distinct (item, win): the item's windows."""
    w = items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).distinct()


def _sized(df: DataFrame, per_row: int, most: int) -> DataFrame:
    """``df``, marked for broadcast if its measured rows fit the bound."""
    return F.broadcast(df) if df.count() * per_row <= most else df


def _places(own: DataFrame, shingles: DataFrame) -> DataFrame:
    """Rows of ``own``, and in rows with ``sh`` the places of the shingles in them, by words
    that meet a broadcast table."""
    words_of = shingles.select("sh", F.posexplode(F.split("sh", " ")).alias("at", "word"))
    counts = words_of.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    gates = words_of.join(counts, "word").groupBy("sh").agg(F.min(F.struct("n", "word", "at")).alias("g")).select("sh", F.split("sh", " ").alias("ws"), "g.word", "g.at")
    # the empty word stands for the document itself, so that each one comes through the join
    gates = gates.unionByName(own.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("at")), allowMissingColumns=True)
    probe = own.select("id1", "id2", "key", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    start = F.col("pos") - F.col("at")  # 1-based, as pos counts the empty word
    last = start + F.size("ws") - 1
    inside = (start >= 1) & (last <= F.size("w"))
    same = inside & (F.get("w", start - 1) == F.get("ws", F.lit(0))) & (F.get("w", last - 1) == F.element_at("ws", -1)) & (F.slice("w", F.greatest(F.lit(1), start), F.size("ws")) == F.col("ws"))
    return probe.join(F.broadcast(gates), "word").where(F.col("ws").isNull() | same).select("id1", "id2", "key", F.size("w").alias("n_words"), start.alias("pos"), "sh")


def _shuffled_places(own: DataFrame, shingles: DataFrame) -> DataFrame:
    """As ``_places``, by a shuffle of one slim row per word."""
    sized = shingles.withColumn("len", F.size(F.split("sh", " "))).withColumn("h", F.xxhash64("sh"))
    lengths = [r.len for r in sized.select("len").distinct().collect()]  # at most ``token`` numbers
    met = None
    for n in sorted(lengths):
        every = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, n))))
        begins = own.where(F.size("w") >= n).select("id1", "id2", F.posexplode(every).alias("at", "h"))
        some = begins.join(sized.where(F.col("len") == n).select("h", "sh"), "h").select("id1", "id2", (F.col("at") + 1).alias("pos"), "sh")
        met = some if met is None else met.unionByName(some)
    documents = own.select("id1", "id2", "key", F.size("w").alias("n_words"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("sh"))
    if met is None:
        return documents
    asks = met.groupBy(F.col("id1").alias("i1"), F.col("id2").alias("i2")).agg(F.collect_set(F.struct("pos", "sh")).alias("asks"))  # within one document
    found = own.join(asks, (F.col("id1") == F.col("i1")) & (F.col("id2") == F.col("i2"))).select("id1", "id2", "key", "w", F.explode("asks").alias("a"))
    same = F.concat_ws(" ", F.slice("w", F.col("a.pos"), F.size(F.split("a.sh", " ")))) == F.col("a.sh")
    return documents.unionByName(found.where(same).select("id1", "id2", "key", F.size("w").alias("n_words"), "a.pos", "a.sh"))


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    token: int = 5, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit and the ids of the items with occurring windows."""
    win = windows(items, size, item_key, item_text).select("item", F.concat_ws(" ", "win").alias("win"), F.size("win").alias("len"), "win", F.least(F.lit(token), F.size("win")).alias("g"))
    win = win.toDF("item", "win", "len", "ws", "g")
    tokens = F.transform(F.sequence(F.lit(0), F.col("len") - F.col("g")), lambda i: F.concat_ws(" ", F.slice("ws", i + 1, F.col("g"))))
    parts = written(win.select("item", "win", "len", (F.col("len") - F.col("g") + 1).alias("many"), F.posexplode(tokens).alias("at", "sh")), "windows")
    shingles = written(parts.select("sh").distinct(), "shingles")
    # a row is known by 128 bits of its key and text; rows equal in both have equal counts
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.xxhash64(F.col(key), t).alias("id1"), F.xxhash64(F.lit(1), t, F.col(key)).alias("id2"), F.col(key).alias("key"), words(F.col(text)).alias("w"))
    fits = shingles.count() * (96 + 64 * token) <= broadcast_bytes
    met = written(_places(own, shingles) if fits else _shuffled_places(own, shingles), "places")
    seen = met.where(F.col("sh").isNotNull()).select("id1", "id2", "n_words", "pos", "sh").distinct()
    rarity = met.where(F.col("sh").isNotNull()).groupBy("sh").agg(F.count(F.lit(1)).alias("n"))
    # a window with a token that no document has cannot occur
    prefix = (
        parts.join(rarity, "sh").groupBy("item", "win").agg(F.count(F.lit(1)).alias("known"), F.first("many").alias("many"), F.first("len").alias("len"), F.min(F.struct("n", "sh", "at")).alias("rare"))
        .where(F.col("known") == F.col("many")).select("item", "win", "len", "many", "rare.sh", "rare.at")
    )
    prefix = written(prefix, "prefix")
    start = F.col("pos") - F.col("at")
    near = seen.join(_sized(prefix, 96 + 16 * size, broadcast_bytes), "sh").where((start >= 1) & (start + F.col("len") - 1 <= F.col("n_words")))
    near = written(near.select("id1", "id2", start.alias("start"), "item", "win", "len", "many"), "candidates")
    held = parts.select("win", "at", "sh").distinct()
    asked = near.select("id1", "id2", "start", "win", "many").distinct().join(_sized(held, 128 + 16 * size, broadcast_bytes), "win")
    asked = asked.select("id1", "id2", "start", "win", "many", (F.col("start") + F.col("at")).alias("pos"), "sh")
    whole = asked.join(seen.drop("n_words"), ["id1", "id2", "pos", "sh"]).groupBy("id1", "id2", "start", "win").agg(F.count(F.lit(1)).alias("k"), F.first("many").alias("many")).where("k = many").drop("k", "many")
    hits = written(near.join(whole, ["id1", "id2", "start", "win"]).select("id1", "id2", "start", "len", "item"), "hits")
    spans = hits.groupBy("id1", "id2", "start").agg(F.max("len").alias("len"))
    by_row = Window.partitionBy("id1", "id2").orderBy("start")
    stop = F.col("start") + F.col("len")
    reached = F.coalesce(F.max(stop).over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.select("id1", "id2", F.greatest(F.lit(0), stop - F.greatest(F.col("start"), reached)).alias("new"))
    each = covered.unionByName(hits.select("id1", "id2", "item").distinct(), allowMissingColumns=True).groupBy(F.col("id1").alias("i1"), F.col("id2").alias("i2"))
    result = written(each.agg(F.sum("new").cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items")), "hit-documents")
    discard(parts, shingles, prefix, near, hits)
    documents = met.where(F.col("sh").isNull())
    return documents.join(result, (F.col("id1") == F.col("i1")) & (F.col("id2") == F.col("i2")), "left").select(
        F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
