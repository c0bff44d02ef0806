"""N-gram Jaccard join by multiple-global-order filtering, down to components.

Two sets that reach the threshold share a token in the first n - ceil(t n) + 1 tokens of
each, under any order of all tokens that both follow. The first order puts rare tokens
first: frequent ones, counted over the whole corpus, stand last by the class of their count,
and equal classes go by hash. Documents that meet in a prefix token under it are counted
pair by pair where the token is not frequent: below the lesser of the two prefixes' ends, all
their common tokens are among these, so the count and what lies beyond bound the overlap, and
few pairs that only share a passage pass. Frequent tokens, which stand in a prefix only where
nearly all of a document is frequent, join their documents without pairs. The connected
documents form candidate groups. In a group, pairs that meet under the first order must also
share a prefix token under a second and a third order (other mixes of the hash) and have
lengths that allow the threshold; only then are the sets compared, exactly.

Only components are asked for, so a pair that is already connected is not compared: in a
group of near copies one comparison connects a member. Equal sets are linked by their digest
and stand for one another before any of this.

A group beyond ``group_rows`` goes through two rounds first. In each its members are dealt out
by the first token of their set under one of the further orders, which near copies mostly
share, in blocks of bounded size, and compared there. What is connected after that need not
meet again: members are cut into blocks by component, and only pairs of blocks of different
components, or of the small ones, become tasks. So a group of near copies costs a few rounds of
its size, no task holds an unbounded group, and no link is lost.

The frequent tokens are at most ``hot_tokens``, the bound of the one broadcast array: the
least count that makes a token frequent is raised until they fit. Any choice is right, it
only moves work: a token that stands in more than ``pair_rows`` prefixes joins its documents
without pairs too, whatever its count. Which documents are candidates is broadcast behind a
check of its size.

Defined results: null text or no words gives the empty set, linked with nothing; fewer words
than ``n`` make one shingle of all; rows of one key and equal text are one document; a null
key gets a null component; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import bounded_batches, discard, partitions, written
from .components import components

_RNG = np.random.default_rng(20240229)
_MULTIPLIERS = _RNG.integers(1, 2**63, 64, dtype="u8") * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Other orders: the hash times an odd number.
_ORDERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
BROADCAST_ROWS = 1 << 20
_CHUNK = 1 << 21
#: Of text whose tokens one range may hold, about, if no file partition is larger than its setting.
_RANGE_BYTES = 16 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and spaces only
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    if len(h) < n:
        return _mixed((h * _MULTIPLIERS[n : n + len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[: len(h) - n + 1] * _MULTIPLIERS[0]
    for k in range(1, n):
        total += h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mixed(total))


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def rare_first(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of a sorted set's tokens in the first order."""
    short = s >> np.uint64(16)
    at = np.minimum(np.searchsorted(hot, short), max(0, len(hot) - 1))
    r = np.where(hot[at] == short, rank[at], 0) if len(hot) else np.zeros(len(s), "u1")
    return np.lexsort((s, r)), r


def _merged(width: int, least: int):
    """Tokens that occur ``least`` times or more, by ranges of sorted rows. A range's chunks are
    gathered until they hold as many tokens as its counts do, and merged into them then, so a
    token is moved a few times however many chunks there are."""

    def run(batches):
        values, counts, held, size, bucket = np.empty(0, "u8"), np.empty(0, "i8"), [], 0, None

        def merge():
            nonlocal values, counts, held, size
            new, k = np.unique(np.concatenate(held), return_counts=True)
            every = np.concatenate([values, new])
            order = np.argsort(every, kind="stable")
            every, both = every[order], np.concatenate([counts, k])[order]
            first = np.flatnonzero(np.diff(every, prepend=every[0] + np.uint64(1)))
            values, counts, held, size = every[first], np.add.reduceat(both, first), [], 0

        def done():
            if held:
                merge()
            keep = counts >= least
            return pa.RecordBatch.from_arrays([pa.array(values[keep].astype("i8")), pa.array(counts[keep])], names=["token", "n"])

        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("tokens").to_pylist()):
                if b != bucket:
                    if bucket is not None:
                        yield done()
                    values, counts, held, size, bucket = np.empty(0, "u8"), np.empty(0, "i8"), [], 0, b
                w = blob[0]
                raw = np.frombuffer(zstandard.decompress(blob[1:]), "u1").reshape(w, -1)
                t = np.cumsum(np.ascontiguousarray(raw.T).view(f"<u{w}").reshape(-1).astype("u8")) + np.uint64(b * width)
                held.append(t)
                size += len(t)
                if size >= max(_CHUNK, len(values)):
                    merge()
        if bucket is not None:
            yield done()

    return run


def frequent_tokens(docs: DataFrame, n: int, least: int, hot_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens (by the first 48 bits of the hash) and their ranks.

    Each task sorts its tokens and sends them packed, by ranges of the hash, so counting is a
    few large rows per task. Of counts that don't all fit the bound the greatest are taken.
    """
    most = docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    buckets = min(65_536, max(16, max(2, -(-most // _RANGE_BYTES)) * partitions(docs)))  # rows sent are ranges times chunks, so no more than memory asks for
    width = (1 << 48) // buckets + 1

    def sent(batches):
        seen, held, size = set(), [], 0

        def out():
            t = np.sort(np.concatenate(held)) if held else np.empty(0, "u8")
            b = (t // np.uint64(width)).astype("i4")
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            names, blobs = [], []
            for i, j in zip(cuts, [*cuts[1:], len(t)]):
                gaps = np.diff(t[i:j], prepend=np.uint64(int(b[i]) * width))
                names.append(int(b[i]))
                kind = "<u4" if int(gaps.max()) < 2**32 else "<u8"
                raw = np.ascontiguousarray(gaps.astype(kind)).view("u1").reshape(len(gaps), -1).T.tobytes()
                blobs.append(bytes([int(kind[2])]) + zstandard.compress(raw, 1))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "tokens"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, n)
                d = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and d not in seen:  # a copy adds nothing to rarity
                    seen.add(d)
                    held.append(s >> np.uint64(16))
                    size += len(s)
            if size >= _CHUNK:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    asked = docs.select("text").mapInArrow(sent, "bucket int, tokens binary")
    found = written(asked.repartition(min(buckets, 4 * partitions(docs)), "bucket").sortWithinPartitions("bucket").mapInArrow(_merged(width, least), "token long, n long"), "frequent")
    # counts by their first seven bits, at most 64 for each power of two
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("n")) - 6, F.lit(0))).cast("long")
    classes = {r.c: r.k for r in found.groupBy((F.col("n") - F.col("n") % step).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}
    low, left = least, hot_tokens
    for c in sorted(classes, reverse=True):
        if classes[c] > left:
            low = c + (1 << max(0, c.bit_length() - 7))
            break
        left -= classes[c]
    hot = found.where(F.col("n") >= low).toPandas()  # at most hot_tokens rows
    discard(found)
    order = np.argsort(hot["token"].to_numpy("u8"))
    return hot["token"].to_numpy("u8")[order], np.floor(np.log2(hot["n"].to_numpy("f8")[order])).astype("u1")


class _Group:
    """Sets of one task's documents; linked ones are joined."""

    def __init__(self, sets: list[np.ndarray], firsts: list[np.ndarray], percent: int, known: np.ndarray):
        self.sets, self.firsts, self.percent = sets, firsts, percent
        self.n = np.array([len(s) for s in sets])
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        self.root = first[which]  # members of one known component are connected
        self.others: list = [None] * len(sets)
        self.done: set[tuple[int, int]] = set()

    def prefixes(self, i: int) -> tuple[np.ndarray, ...]:
        """Prefix tokens under the further orders."""
        if self.others[i] is None:
            s, p = self.sets[i], prefix_length(len(self.sets[i]), self.percent)
            self.others[i] = tuple(s[np.argpartition(s * m, p - 1)[:p]] if p < len(s) else s for m in _ORDERS)
        return self.others[i]

    def _shared(self, x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
        x = np.sort(x)
        every, ends = np.concatenate(ys), np.cumsum([len(y) for y in ys])
        hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[ends] - total[ends - [len(y) for y in ys]]

    def compare(self, x: int, ys: np.ndarray) -> None:
        low, high = np.minimum(self.n[x], self.n[ys]), np.maximum(self.n[x], self.n[ys])
        ys = ys[100 * low >= self.percent * high]
        for k in range(len(_ORDERS)):
            if len(ys):
                ys = ys[self._shared(self.prefixes(x)[k], [self.prefixes(y)[k] for y in ys]) > 0]
        if len(ys):
            both = self._shared(self.sets[x], [self.sets[y] for y in ys])
            for y in ys[100 * both >= self.percent * (self.n[x] + self.n[ys] - both)]:
                a, b = self.root[x], self.root[y]
                if a != b:
                    self.root[self.root == max(a, b)] = min(a, b)

    def bucket(self, members: np.ndarray) -> None:
        """Compare what shares a token and is not yet connected."""
        left = members
        while len(left) > 1:
            apart = left[self.root[left] != self.root[left[0]]]
            if not len(apart):
                return
            x, left = int(left[0]), left[1:]
            new = np.array([y for y in apart.tolist() if (x, y) not in self.done], "i8")
            if len(new):
                self.done.update((x, y) for y in new.tolist())
                self.compare(x, new)

    def run(self) -> np.ndarray:
        tokens = np.concatenate(self.firsts)
        owner = np.repeat(np.arange(len(self.firsts)), [len(f) for f in self.firsts])
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.diff(tokens, prepend=tokens[0] + np.uint64(1)))
        ends = np.append(starts[1:], len(tokens))
        seen = set()
        for i, j in zip(starts, ends):
            if j - i > 1 and (key := owner[i:j].tobytes()) not in seen:
                seen.add(key)
                self.bucket(owner[i:j])
        return self.root


def _sized(df: DataFrame) -> DataFrame:
    """Two longs a row, marked for broadcast if the counted rows fit the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _scanned(n: int, percent: int, shared):
    """Per document: set size, digest, and its prefix under the first order with what is frequent."""

    def run(batches):
        hot, rank = shared.value
        for b in batches:
            sizes, digests, prefixes, hots, rares, lasts = [], [], [], [], [], []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                s = shingle_set(t, n)
                d = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                digests.append(d)
                if k is None or not len(s):
                    prefixes.append(np.empty(0, "i8"))
                    hots.append(np.empty(0, "bool"))
                    rares.append(0)
                    lasts.append(0)
                    continue
                at, r = rare_first(s, hot, rank)
                at = at[: prefix_length(len(s), percent)]
                prefixes.append(s[at].astype("i8"))
                hots.append(r[at] > 0)
                rare = int((r[at] == 0).sum())
                rares.append(rare)
                lasts.append(int(s[at[rare - 1]]) - 2**63 if rare else 0)  # in the order of the hash
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (prefixes, hots)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists, pa.array(rares, pa.int64()), pa.array(lasts, pa.int64())], names=["key", "n", "digest", "prefix", "hot", "rare", "last"])

    return run


def _firsts(n: int):
    """The first token of each set under each further order."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, n) for t in b.column("text").to_pylist()]
            for o, m in enumerate(_ORDERS):
                token = np.array([int(s[np.argmin(s * m)]) for s in sets], "u8").astype("i8")
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), pa.array(np.full(len(sets), o, "i4")), pa.array(token)], names=["node", "root", "turn", "token"])

    return run


_SETS = "root long, i long, j long, node long, known long, tokens binary, first binary"


def _sets(n: int, percent: int, shared):
    """The sets of documents, with their prefixes, for each pair of blocks (i, j) that they are in."""

    def run(batches):
        hot, rank = shared.value
        for b in batches:
            out = []
            for node, root, known, pairs, t in zip(*(b.column(c).to_pylist() for c in ("node", "root", "known", "pairs", "text"))):
                s = shingle_set(t, n)
                first = s[rare_first(s, hot, rank)[0][: prefix_length(len(s), percent)]].tobytes()
                out += [(root, p["i"], p["j"], node, known, s.tobytes(), first) for p in pairs]
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _SETS.split(", ")])


def _linked(percent: int):
    """Links found in each group of sorted rows."""

    def done(nodes, known, tokens, firsts):
        if len(set(known)) < 2:
            return [], []
        g = _Group([np.frombuffer(x, "u8") for x in tokens], [np.frombuffer(x, "u8") for x in firsts], percent, np.array(known))
        root = g.run()
        mine = np.flatnonzero(root != np.arange(len(root)))
        return [nodes[k] for k in mine], [nodes[k] for k in root[mine]]

    def run(batches):
        at, held = None, ([], [], [], [])
        for b in batches:
            a, c = [], []
            for r in zip(*(b.column(x).to_pylist() for x in ("root", "i", "j", "node", "known", "tokens", "first"))):
                if r[:3] != at:
                    x, y = done(*held)
                    a += x
                    c += y
                    at, held = r[:3], ([], [], [], [])
                for k in range(4):
                    held[k].append(r[3 + k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
        x, y = done(*held)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def _blocked(members: DataFrame, group_rows: int) -> DataFrame:
    """Members (node, root, known) of large groups with the pairs of blocks that they are in.
    Blocks of the small components are numbered first, then those of each large one."""
    sizes = members.groupBy("root", "known").agg(F.count(F.lit(1)).alias("k"))
    large = F.col("k") >= group_rows
    groups = sizes.groupBy(F.col("root").alias("r")).agg(
        F.count(F.lit(1)).alias("comps"),
        F.ceil(F.coalesce(F.sum(F.when(~large, F.col("k"))), F.lit(0)) / group_rows).cast("long").alias("pool"),
        F.sort_array(F.collect_list(F.when(large, F.struct("known", F.ceil(F.col("k") / group_rows).cast("long").alias("blocks"))))).alias("large"),
    ).where("comps > 1")  # at most one entry for each group_rows members; a connected group has nothing left to compare
    met = members.join(groups, F.col("root") == F.col("r"))
    own = F.array_position(F.transform("large", lambda c: c["known"]), F.col("known"))
    before = lambda i: F.col("pool") + F.aggregate(F.slice("large", 1, i.cast("int")), F.lit(0).cast("long"), lambda a, c: a + c["blocks"])
    met = met.withColumn("at", own).withColumn("total", before(F.size("large")))
    mine = F.when(F.col("at") > 0, before(F.col("at") - 1) + F.pmod(F.xxhash64("node"), F.get("large", F.col("at").cast("int") - 1)["blocks"])).otherwise(
        F.pmod(F.xxhash64("known"), F.col("pool"))
    )
    met = met.withColumn("mine", mine).withColumn("low", F.when(F.col("at") > 0, before(F.col("at") - 1))).withColumn("high", F.when(F.col("at") > 0, before(F.col("at"))))
    every = F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda o: F.col("low").isNull() | (o < F.col("low")) | (o >= F.col("high")))
    pairs = F.transform(every, lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    return met.select("node", "root", "known", pairs.alias("pairs"))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, least: int = 8, hot_tokens: int = 1 << 19, group_rows: int = 4096, pair_rows: int = 256
) -> DataFrame:
    """Columns key, n_shingles, component_id (the least key reachable by links, itself included)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(frequent_tokens(own, n, least, hot_tokens))
    scan = written(own.mapInArrow(_scanned(n, percent, shared), "key long, n long, digest binary, prefix array<long>, hot array<boolean>, rare long, last long"), "jaccard")
    real = scan.where(F.col("key").isNotNull() & (F.col("n") > 0))
    # the least key of equal sets stands for them
    copies = real.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select(F.col("digest").alias("d"), "least")
    same = written(real.select("key", "digest").join(copies, (F.col("digest") == F.col("d")) & (F.col("key") > F.col("least"))).select(F.col("key").alias("a"), F.col("least").alias("b"), "d").distinct(), "jaccard-same")
    reps = real.join(_sized(same.select("a", "d")), (F.col("key") == F.col("a")) & (F.col("digest") == F.col("d")), "leftanti")
    # a frequent token's documents are dealt to salted parts, whose least members then meet
    met = reps.select("key", "n", "rare", "last", F.explode(F.arrays_zip("prefix", "hot")).alias("t")).select(
        F.col("t.prefix").alias("token"), F.when(F.col("t.hot"), F.pmod(F.xxhash64("key"), F.lit(64))).otherwise(-1).alias("salt"), "key", "n", "rare", "last"
    )
    same_token = Window.partitionBy("token", "salt")
    met = met.withColumn("lead", F.min("key").over(same_token)).withColumn("most", F.max("key").over(same_token)).withColumn("rows", F.count(F.lit(1)).over(same_token))
    met = met.withColumn("star", (F.col("salt") >= 0) | (F.col("rows") > pair_rows))
    met = written(met.where((F.col("lead") != F.col("most")) | (F.col("salt") >= 0)).drop("most", "rows", "salt"), "jaccard-met")
    stars = met.where("star").select(F.col("key").alias("a"), F.col("lead").alias("b"), "token")
    heads = stars.where("a = b").select("token", "a").distinct()
    heads = heads.withColumn("b", F.min("a").over(Window.partitionBy("token")))  # at most one row a salt
    rare = met.where("not star")
    x, y = (rare.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "rare", "last")]) for side in "xy")
    sized = (F.col("key_x") < F.col("key_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    met_in = x.join(y, (x["token"] == y["token"]) & sized).groupBy("key_x", "key_y").agg(F.count(F.lit(1)).alias("c"), *[F.max(f"{c}_{s}").alias(f"{c}_{s}") for c in ("n", "rare", "last") for s in "xy"])
    beyond = F.when(F.col("last_x") <= F.col("last_y"), F.col("n_x") - F.col("rare_x")).otherwise(F.col("n_y") - F.col("rare_y"))
    enough = (100 + percent) * (F.col("c") + beyond) >= percent * (F.col("n_x") + F.col("n_y"))
    close = met_in.where(enough).select(F.col("key_x").alias("a"), F.col("key_y").alias("b"))
    groups = components(close.unionByName(stars.select("a", "b").distinct()).unionByName(heads.select("a", "b")))
    # every member of a group, roots too
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group_rows).select(F.col("root").alias("r"), F.lit(True).alias("large"))
    members = written(members.join(sizes, F.col("root") == F.col("r"), "left").select("node", "root", F.coalesce("large", F.lit(False)).alias("large")), "jaccard-groups")

    def compared(dealt: DataFrame) -> DataFrame:
        """Links among (node, root, known, pairs)."""
        texts = own.join(_sized(dealt), F.col("key") == F.col("node")).select("node", "root", "known", "pairs", "text")
        sets = texts.mapInArrow(_sets(n, percent, shared), _SETS).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
        return sets.mapInArrow(_linked(percent), "a long, b long")

    pair = lambda i, j: F.array(F.struct(i.cast("long").alias("i"), j.cast("long").alias("j")))
    found, tables = compared(members.where("not large").select("node", "root", F.col("node").alias("known"), pair(F.lit(0), F.lit(0)).alias("pairs"))), []
    crowd = members.where("large").select("node", "root")
    if not crowd.isEmpty():
        texts = own.join(_sized(crowd), F.col("key") == F.col("node")).select("node", "root", "text")
        firsts = written(texts.mapInArrow(_firsts(n), "node long, root long, turn int, token long").distinct(), "jaccard-firsts")
        block = F.pmod(F.xxhash64("node", "turn"), F.ceil(F.col("k") / group_rows))
        many = firsts.groupBy("root", "turn", "token").agg(F.count(F.lit(1)).alias("k"))
        rounds = firsts.join(many, ["root", "turn", "token"]).groupBy("node", F.col("node").alias("known")).agg(
            F.collect_list(F.struct(F.xxhash64("root", "turn", "token").alias("i"), block.alias("j"))).alias("pairs")  # one a turn
        )
        near = written(compared(rounds.select("node", F.lit(0).cast("long").alias("root"), "known", "pairs")), "jaccard-near")
        classes = components(near)
        left = crowd.join(classes.withColumnRenamed("root", "class"), "node", "left").select("node", "root", F.coalesce("class", "node").alias("known"))
        left = written(_blocked(left, group_rows), "jaccard-blocks")
        found = found.unionByName(near).unionByName(compared(left))
        tables = [firsts, near, left]
    classes = components(found.unionByName(same.select("a", "b")))
    discard(met, members, same, *tables)
    return scan.select("key", "n").join(classes, F.col("key") == F.col("node"), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("component_id")
    )
