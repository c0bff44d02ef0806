"""Removal of repeated byte strings, with suffix arrays built by linear grouping.

Every ``size``-byte window has an anchor: of its ``size // 2``-byte strings the one with the
least hash, the leftmost of equals. Equal windows have equal anchors at equal places, and the
windows of one anchor lie side by side, so their union, the anchor's context, is all that a
document must show for them. Each window belongs to one anchor and is judged once.

Contexts are compared only with those of the same anchor. Equal ones (128 bits of two hashes)
are repeats as a whole and stand for one another. Of anchors with several distinct contexts
the bytes are fetched, and each context is written as the edges of two path-compressed tries,
of what stands before (backwards) and after the anchor: two contexts share exactly the edges
up to where they first differ, so no repeat boundary falls inside a symbol. A suffix array
over these sequences gives each suffix's longest match with another; a match of ``size`` bytes
or more is a repeat, and every repeat starts at such a symbol.

A task drops its own repeats of a context before the shuffle, and keeps the spans that it
knows with their document, so a passage that a third of all documents share is a row per
chunk. An anchor with more than ``group_rows`` distinct contexts is split: its windows go to
parts by how far they reach before the anchor, and a part's anchor is all that its windows
have in common, first in eight parts, then window by window. A task whose own texts have too
many contexts of an anchor splits it itself and sends a mark, by which the others follow; so
no task gets more than about ``anchor_rows`` rows of one anchor, no group is unbounded, no
pairs are formed and no repeat is lost.

Defined results: null text is empty; texts under ``size`` bytes have no repeats; every row is
a place of its own, also where keys and texts repeat; a row with a null key is matched
against and left whole; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, by_bytes, discard, partitions, written
from .suffixes import longest_matches

_RNG = np.random.default_rng(20240301)
_BYTES = _RNG.integers(0, 2**63, 256, dtype="u8") * np.uint64(2) + _RNG.integers(0, 2, 256, dtype="u8")
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]
#: Bytes of text whose contexts are compared before the shuffle; window starts hashed at once.
CHUNK = 16 << 20
_SLAB = 1 << 16
_PLACE = np.uint64((1 << 17) - 1)
#: Parts of an anchor's windows, by level.
PARTS = (1, 8, 1 << 30)
_ROW = "kind int, ah long, ch long, id1 long, id2 long, at int, lo int, hi int, n int"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    while len(_powers[0]) < n:
        k = len(_powers[0])
        for side, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[side] = np.concatenate([_powers[side], _powers[side] * np.uint64(pow(base, k, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by doubling."""
    have, out = 1, a
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(a) - width + 1], out[width - have :]) if have < width else out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    new = np.ones(len(columns[0]), "bool")
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def anchors(raw: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one after the other: anchors' places, hashes, first and last windows."""
    k, n = size // 2, len(raw) - size + 1
    long = np.diff(bounds) >= size
    if not long.any():
        return np.empty(0, "i8"), np.empty(0, "u8"), np.empty(0, "i8"), np.empty(0, "i8")
    edge = np.zeros(n + 1, "i1")
    edge[bounds[:-1][long]] += 1
    edge[bounds[1:][long] - size + 1] -= 1
    inside = np.cumsum(edge[:n], dtype="i1").view("bool")  # windows that cross no end
    found = []
    for a in range(0, n, _SLAB):
        m = min(_SLAB, n - a)
        part, ok = raw[a : a + m + size - 1], inside[a : a + m]
        power, inverse = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, "u8")
        np.cumsum(_BYTES[part] * power[:-1], out=total[1:])
        h = _mixed((total[k:] - total[:-k]) * inverse[: len(part) - k + 1])
        at = _least((h & ~_PLACE) | np.arange(len(h), dtype="u8"), size - k + 1) & _PLACE
        turn = at[1:] != at[:-1]
        first, last = ok.copy(), ok.copy()
        first[1:] &= turn | ~ok[:-1]
        last[:-1] &= turn | ~ok[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        at = at[lo].astype("i8")
        found.append((at + a, h[at], lo + a, hi + a))
    at, h, lo, hi = (np.concatenate(x) for x in zip(*found))
    whole = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (lo[1:] != hi[:-1] + 1)))  # slabs cut some
    return at[whole], h[whole], lo[whole], hi[np.append(whole[1:], len(at)) - 1]


def _step(level: int, size: int) -> int:
    """How many places of a window's front, counted from the anchor, are in one part."""
    return max(1, -(-(size - size // 2 + 1) // PARTS[level]))


def _core(at: np.ndarray, hi: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What all windows of a context's part have in common: its start and end."""
    if level == 0:
        return at, at + size // 2
    step = _step(level, size)
    near = (at - hi) // step * step
    return at - near, at + size - np.minimum(near + step - 1, size - size // 2)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, shape: np.ndarray) -> np.ndarray:
    view, h = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter((h(view[a:b], s) for a, b, s in zip(start.tolist(), end.tolist(), shape.tolist())), "u8", len(start))


def _contexts(raw: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    return _hashes(raw, lo, hi + size, (at - lo) * 2 * size + (hi - lo))


def split(raw: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> tuple[np.ndarray, ...]:
    """Contexts of the level above in parts: their numbers, then at, anchor hash, lo, hi, context hash."""
    step = _step(level, size)
    near, far = (at - hi) // step, (at - lo) // step
    many = far - near + 1
    own = np.repeat(np.arange(len(at)), many)
    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - near, many)
    at = at[own]
    lo, hi = np.maximum(lo[own], at - part * step - step + 1), np.minimum(hi[own], at - part * step)
    start, end = _core(at, hi, level, size)
    return own, at, _hashes(raw, start, end, part * 4 + level), lo, hi, _contexts(raw, at, lo, hi, size)


def _texts(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column ``raw``, one after the other, and their bounds."""
    a = pa.concat_arrays([b.column("raw") for b in batches])
    bounds = np.frombuffer(a.buffers()[1], "<i4")[a.offset : a.offset + len(a) + 1].astype("i8")
    data = np.frombuffer(a.buffers()[2] or b"", "u1")[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _rows(kind: int, *columns) -> Iterator[pa.RecordBatch]:
    """Batches of ``_ROW``; a single number stands for a column."""
    n = max((len(c) for c in columns if isinstance(c, np.ndarray)), default=0)
    names = [x.split()[0] for x in _ROW.split(", ")]
    full = [np.full(n, c) if np.isscalar(c) else c for c in (kind, *columns)]
    for i in range(0, n, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)].astype(t.to_pandas_dtype())) for c, t in zip(full, _KINDS)], names=names)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans, by document; spans are places in texts one after the other."""
    order = np.argsort(start, kind="stable")
    doc, start, end = doc[order], start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, (start[1:] > end[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, "i8")
    return doc[new], start[new], end[np.append(new[1:], len(end)) - 1] if len(new) else end


def _located(size: int, most: int):
    """Kind 0: spans that repeat within the chunk. Kind 1 and up, by level: one row of each
    distinct context of a chunk, with how often it occurs (2 at most, 0 for a mark)."""

    def out(batches):
        raw, bounds = _texts(batches)
        id1, id2 = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("id1", "id2"))
        at, ah, lo, hi = anchors(raw, bounds, size)
        ch, n, spans = _contexts(raw, at, lo, hi, size), np.ones(len(at), "i8"), []
        for level in range(len(PARTS)):
            order = np.lexsort((lo, ch, ah))
            at, ah, lo, hi, ch, n = (c[order] for c in (at, ah, lo, hi, ch, n))
            if not len(at):
                break
            run = _runs(ah, ch)
            count = np.minimum(2, np.add.reduceat(n, run))
            again = np.repeat(count > 1, np.diff(np.append(run, len(at))))
            spans.append((lo[again], hi[again] + size))
            at, ah, lo, hi, ch, n = at[run], ah[run], lo[run], hi[run], ch[run], count
            group = _runs(ah)
            many = np.diff(np.append(group, len(ah)))
            hot = np.repeat(many > (most if level + 1 < len(PARTS) else len(ah)), many)
            doc = np.searchsorted(bounds, lo, "right") - 1
            base = bounds[doc]
            cold = ~hot
            yield from _rows(level + 1, ah[cold], ch[cold], id1[doc[cold]], id2[doc[cold]], (at - base)[cold], (lo - base)[cold], (hi - base)[cold], n[cold])
            if not hot.any():
                break
            mark = group[hot[group]]
            yield from _rows(level + 1, ah[mark], 0, id1[doc[mark]], id2[doc[mark]], 0, 0, 0, 0)
            own, at, ah, lo, hi, ch = split(raw, at[hot], lo[hot], hi[hot], level + 1, size)
            n = n[hot][own]
        if spans:
            start, end = (np.concatenate(x) for x in zip(*spans))
            doc, start, end = _merged(np.searchsorted(bounds, start, "right") - 1, start, end)
            yield from _rows(0, id1[doc], np.arange(len(doc)), id1[doc], id2[doc], 0, start - bounds[doc], end - bounds[doc], 2)

    def run(batches):
        for some in by_bytes(batches, CHUNK):
            yield from out(some)

    return run


def _judged(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` with how often their context occurs, whether they stand for it, the distinct
    contexts of their anchor, and whether it is marked; up to ``level``, those that matter."""
    context = Window.partitionBy("kind", "ah", "ch").orderBy("id1", "id2", "lo")
    every = context.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    anchor = Window.partitionBy("kind", "ah")
    return (
        rows.repartition("kind", "ah")
        .withColumn("copies", F.sum("n").over(every)).withColumn("head", (F.row_number().over(context) == 1) & (F.col("n") > 0))
        .withColumn("contexts", F.sum(F.col("head").cast("int")).over(anchor)).withColumn("marked", F.min("n").over(anchor) == 0)
        .where((F.col("kind") == 0) | (F.col("kind") > level + 1) | (F.col("copies") > 1) | (F.col("head") & ((F.col("contexts") > 1) | F.col("marked"))))
    )


def _fetched(own: DataFrame, asks: DataFrame, level: int, size: int, run, schema: str) -> DataFrame:
    """``run`` over batches of (raw, asks) of the documents that hold the asked contexts."""
    per_doc = asks.groupBy(F.col("id1").alias("i1"), F.col("id2").alias("i2")).agg(F.collect_list(F.struct("ah", "at", "lo", "hi", "n")).alias("asks"))

    def each(batches):
        for some in by_bytes(batches, CHUNK):
            raw, bounds = _texts(some)
            asked = pa.concat_arrays([b.column("asks") for b in some])
            doc = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            ah, at, lo, hi, n = (asked.flatten().field(i).to_numpy() for i in range(5))
            ids = [np.concatenate([b.column(c).to_numpy() for b in some])[doc] for c in ("id1", "id2")]
            yield from run(raw, bounds[doc], *ids, ah, *(c + bounds[doc] for c in (at, lo, hi)), n, level)

    # copies of a row are one document here
    met = own.join(per_doc, (F.col("id1") == F.col("i1")) & (F.col("id2") == F.col("i2"))).select("id1", "id2", "raw", "asks")
    return met.mapInArrow(each, schema)


def _cut(size: int):
    """The bytes of contexts, with the place and length of what their group has in common."""

    def run(raw, base, id1, id2, ah, at, lo, hi, n, level):
        start, end = _core(at, hi, level, size)
        for i in range(0, len(at), 1 << 14):
            j = slice(i, i + (1 << 14))
            view, names = memoryview(raw), ["ah", "id1", "id2", "lo", "before", "core", "context"]
            blobs = [bytes(view[a:b]) for a, b in zip(lo[j].tolist(), (hi[j] + size).tolist())]
            columns = [ah[j], id1[j], id2[j], (lo - base)[j], (start - lo)[j], (end - start)[j]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype("i8")) for c in columns), pa.array(blobs, pa.binary())], names=names)

    return run


def _refined(size: int):
    def run(raw, base, id1, id2, ah, at, lo, hi, n, level):
        own, at, ah, lo, hi, ch = split(raw, at, lo, hi, level, size)
        base = base[own]
        yield from _rows(level + 1, ah, ch, id1[own], id2[own], at - base, lo - base, hi - base, n[own])

    return run


def _strings(raw: np.ndarray, start: np.ndarray, step: int, length: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes from ``start`` on, forwards or backwards; 0 stands behind the end."""
    at = np.arange(width)
    within = at < length[:, None]
    kind = "u1" if raw.max(initial=0) < 255 else ">u2"
    return np.where(within, raw[np.where(within, start[:, None] + step * at, 0)].astype(kind) + np.array(1, kind), np.array(0, kind)).astype(kind)


def _order(group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(strings).view("u1").reshape(len(strings), -1)
    keys = np.concatenate([group.astype(">u4").view("u1").reshape(-1, 4), flat], 1)
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").reshape(-1), kind="stable")


def _shared(group: np.ndarray, strings: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Leading places that each string has in common with the one before, -1 in another group."""
    out = np.full(len(group), -1)
    if len(group) > 1:
        differ = strings[1:] != strings[:-1]
        first = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
        out[1:] = np.where(group[1:] == group[:-1], np.minimum(first, np.minimum(length[1:], length[:-1])), -1)
    return out


def _most_shared(group: np.ndarray, strings: np.ndarray, length: np.ndarray) -> np.ndarray:
    order = _order(group, strings)
    same = _shared(group[order], strings[order], length[order])
    out = np.empty(len(group), "i8")
    out[order] = np.maximum(np.maximum(same, np.append(same[1:], -1)), 0)
    return out


def _edges(group: np.ndarray, strings: np.ndarray, length: np.ndarray, fresh: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Each string as the edges (symbol, width) of the path-compressed trie of its group, up to
    where it is on its own; the next free symbol."""
    order = _order(group, strings)
    same = _shared(group[order], strings[order], length[order]).tolist()
    depth, parent, leaf, stack = [0], [-1], [0] * len(order), [0]
    for r, (i, c) in enumerate(zip(order.tolist(), same)):
        if c < 0:
            stack = [0]
        elif c < depth[stack[-1]]:
            last = -1
            while depth[stack[-1]] > c:
                last = stack.pop()
            if depth[stack[-1]] < c:
                depth.append(c)
                parent.append(stack[-1])
                parent[last] = len(depth) - 1
                stack.append(len(depth) - 1)
        after = same[r + 1] if r + 1 < len(same) else -1
        if after > depth[stack[-1]]:
            depth.append(after)
            parent.append(stack[-1])
            stack.append(len(depth) - 1)
        leaf[i] = stack[-1]
    out = []
    for v in leaf:
        path = []
        while v:
            path.append((fresh + v, depth[v] - depth[parent[v]]))
            v = parent[v]
        path.reverse()
        out.append(path)
    return out, fresh + len(depth)


def repeats(group: np.ndarray, raw: np.ndarray, bounds: np.ndarray, before: np.ndarray, core: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts that stand one after the other, with a common part in each group: numbers of
    those with a repeat, and its start and end in the context. All repeats of a context hold
    the common part, so they are one span."""
    width = size - int(core.min())
    start, after = bounds[:-1] + before, np.diff(bounds) - before - core

    def sides(i):
        return (
            (group[i], _strings(raw, start[i] - 1, -1, before[i], width), before[i]),
            (group[i], _strings(raw, start[i] + core[i], 1, after[i], width), after[i]),
        )

    # what shares too little with any other matches nothing
    some = np.flatnonzero(sum(_most_shared(*s) for s in sides(np.arange(len(group)))) + core >= size)
    if not len(some):
        return some, some, some
    left, right = sides(some)
    lefts, fresh = _edges(*left, 0)
    rights, fresh = _edges(*right, fresh)
    symbols, widths, first, lead = [], [], [], []
    last = fresh + int(group.max()) + 1  # from here on, symbols that end a context
    for r, (g, c, x, y) in enumerate(zip(group[some].tolist(), core[some].tolist(), lefts, rights)):
        first.append(len(symbols))
        lead.append(sum(w for _, w in x))
        path = [*x[::-1], (fresh + g, c), *y, (last + r, 0)]
        symbols += [v for v, _ in path]
        widths += [w for _, w in path]
    best = np.array(longest_matches(symbols))
    first, at = np.array(first), np.arange(len(symbols))
    ends = np.concatenate([[0], np.cumsum(widths)])
    length = ends[at + best] - ends[:-1]
    hit = np.flatnonzero(length >= size)
    owner = np.searchsorted(first, hit, "right") - 1
    begin = (before[some] - np.array(lead))[owner] + ends[hit] - ends[first[owner]]
    run = _runs(owner) if len(owner) else owner
    if not len(run):
        return run, run, run
    return some[owner[run]], np.minimum.reduceat(begin, run), np.maximum.reduceat(begin + length[hit], run)


def _matched(size: int, run_rows: int):
    def out(t: pa.Table):
        ah, lo, before, core = (t.column(c).to_numpy() for c in ("ah", "lo", "before", "core"))
        blobs = t.column("context").combine_chunks()
        raw, bounds = _texts([pa.RecordBatch.from_arrays([blobs], names=["raw"])])
        view, met = memoryview(raw), {}  # groups hold equal bytes, not only equal hashes
        group = np.fromiter((met.setdefault((h, bytes(view[a : a + c])), len(met)) for h, a, c in zip(ah.tolist(), (bounds[:-1] + before).tolist(), core.tolist())), "i8", len(ah))
        which, start, end = repeats(group, raw, bounds, before, core, size)
        return pa.RecordBatch.from_arrays(
            [*(t.column(c).take(pa.array(which)).combine_chunks() for c in ("id1", "id2")), pa.array(lo[which] + start), pa.array(lo[which] + end)], names=["id1", "id2", "lo", "finish"]
        )

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= run_rows:
                t = pa.Table.from_batches(held)
                ah = t.column("ah").to_numpy()
                cut = int(_runs(ah)[-1])
                if cut:
                    yield out(t.slice(0, cut))
                held, rows = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if rows:
            yield out(pa.Table.from_batches(held))

    return run


def _stripped(batches):
    for some in by_bytes(batches, CHUNK):
        raw, bounds = _texts(some)
        spans = pa.concat_arrays([b.column("spans") for b in some])
        doc = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        start, end = (spans.flatten().field(i).to_numpy() + bounds[doc] for i in range(2))
        doc, start, end = _merged(doc, start, end)
        edge = np.zeros(len(raw) + 1, "i1")  # maximal runs of a document don't touch
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        gone = np.cumsum(edge[:-1], dtype="i1").view("bool")
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[bounds[1:]] - total[bounds[:-1]]
        left = np.concatenate([[0], np.cumsum(np.diff(bounds) - removed)]).astype("<i4")
        kept = pa.Array.from_buffers(pa.binary(), len(spans), [None, pa.py_buffer(left.tobytes()), pa.py_buffer(raw[~gone].tobytes())])
        numbers = (np.diff(bounds), removed, np.bincount(doc, minlength=len(spans)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column("key") for b in some]), *(pa.array(c.astype("i8")) for c in numbers), kept], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])


def _spans(judged: DataFrame, size: int) -> DataFrame:
    finish = F.when(F.col("kind") == 0, F.col("hi")).otherwise(F.col("hi") + size)
    return judged.where((F.col("copies") > 1) & (F.col("n") > 0)).select("id1", "id2", F.col("lo").cast("long").alias("lo"), finish.cast("long").alias("finish"))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 200, group_rows: int = 8192, anchor_rows: int = 1 << 20, run_rows: int = 4096
) -> DataFrame:
    """Columns key, n_bytes, n_removed, n_spans and the bytes that are left, as ``kept``.

    The most distinct contexts that an anchor may have in one group of a suffix array are
    ``group_rows``; ``anchor_rows`` is shared out among the tasks of the first scan; a suffix
    array is built for about ``run_rows`` contexts at a time."""
    if size < 4 or size % 2:
        raise ValueError("size must be even and at least 4")
    spark = docs.sparkSession
    bounded_batches(spark)
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # a row is known by 128 bits of its key and text; rows equal in both have the same spans
    own = docs.select(F.xxhash64(F.col(key), clean).alias("id1"), F.xxhash64(F.lit(1), clean, F.col(key)).alias("id2"), F.col(key).alias("key"), clean.cast("binary").alias("raw"))
    texts, columns = own.select("id1", "id2", "raw"), [x.split()[0] for x in _ROW.split(", ")]
    rows = texts.mapInArrow(_located(size, max(8, anchor_rows // partitions(docs))), _ROW)
    seen, spans, tables = written(_judged(rows, 0), "contexts"), None, []
    for level in range(len(PARTS)):
        tables.append(seen)
        known = _spans(seen, size)
        spans = known if spans is None else spans.unionByName(known)
        heads = seen.where((F.col("kind") == level + 1) & F.col("head")).withColumn("n", F.least(F.lit(2), "copies").cast("int"))
        large = F.col("marked") | (F.col("contexts") > group_rows)
        asked = heads.where(~large & (F.col("contexts") > 1))
        if level + 1 < len(PARTS):  # the last level's contexts are single windows
            found = (
                _fetched(texts, asked, level, size, _cut(size), "ah long, id1 long, id2 long, lo long, before long, core long, context binary")
                .repartition("ah").sortWithinPartitions("ah").mapInArrow(_matched(size, run_rows), "id1 long, id2 long, lo long, finish long")
            )
            tables.append(written(found, "repeats"))
            spans = spans.unionByName(tables[-1])
        split_up = heads.where(large)
        later = seen.where((F.col("kind") > level + 1) & (F.col("head") | (F.col("n") == 0))).withColumn("n", F.least("n", F.least(F.lit(2), "copies")).cast("int"))
        if split_up.isEmpty() and later.isEmpty():
            break
        more = _fetched(texts, split_up, level + 1, size, _refined(size), _ROW)
        seen = written(_judged(more.unionByName(later.select(*columns)), level + 1), "contexts")
    per_doc = written(spans.groupBy(F.col("id1").alias("i1"), F.col("id2").alias("i2")).agg(F.collect_list(F.struct("lo", "finish")).alias("spans")), "repeat-spans")
    discard(*tables)
    met = own.join(per_doc, F.col("key").isNotNull() & (F.col("id1") == F.col("i1")) & (F.col("id2") == F.col("i2")), "left")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return met.select("key", "raw", "spans").mapInArrow(_stripped, schema).withColumnRenamed("key", key)
