"""Packing by minimum bin slack.

Every document is cut into whole windows and one remainder. Only the histogram of remainder
lengths, at most ``window`` - 1 counts whatever the input, reaches the driver. There, one
sequence at a time, the longest remaining length is fixed and a bitset subset-sum program
over the other lengths finds the multiset that leaves least slack; backtracking gives how
often each length is used, and the pattern is repeated as often as the counts allow. The
patterns are a table of (length, rank interval) -> place, and each remainder finds its
sequence and offset from its rank among the remainders of its length.

Ranks come without moving rows: a task numbers its own remainders by length as it writes
them, and per-task counts are prefix-summed. A length that a third of all rows share is
therefore never gathered anywhere.

Defined results: null text is empty, and an empty document is its end id alone; repeated
rows are packed each; an empty table gives no pieces. Columns other than key and text are
not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import BROADCAST_BYTES, by_bytes, written

_MODELS: dict = {}
#: Text that is tokenized at once.
TEXT_BYTES = 8 << 20
#: What the vectorised form needs of a tokenizer file; others go through the library whole.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
#: Words with other characters go through the library: there its tables alone decide case,
#: composition and classes.
_ODD = "[^\x00-\x7F\u00A1-\u024F]"


class WordTokenizer:
    """Ids of texts, a batch at a time, without memory of earlier ones.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words in order. A batch's distinct words are cut into pieces and merged once; each
    occurrence then takes its word's ids by number. Merges run in ``tiktoken``, whose rule,
    the adjacent pair of least rank first, is the same when a merge's rank is the id it makes;
    the mark of a word's end is a space after each piece. Texts with special strings or with
    control characters that separate, and words outside ASCII and Latin letters, go through
    the library itself, and so do all texts if the file is not of this kind.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.whole = "|".join(["[\x1c-\x1f]", *map(re.escape, special)])
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        first = (split.get("pretokenizers") or [{}])[0]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
        ranks = [model["vocab"].get(m, -1) for m in merged]
        self.own = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == _WORD_END and not model.get("dropout")
            and (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and first.get("pattern") == {"Regex": _PIECES} and first.get("behavior") == "Removed" and first.get("invert") is True
            and [t.get("type") for t in split["pretokenizers"]] == ["Split", "ByteLevel"]
            and all(a < b for a, b in zip(ranks, ranks[1:]))
        )
        if not self.own:
            return
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
        table, self.ends = {}, np.zeros(max(model["vocab"].values()) + 1, "bool")
        for token, i in model["vocab"].items():
            if token not in special:
                last = token.endswith(_WORD_END) and token != _WORD_END
                body = token.removesuffix(_WORD_END) if last else token
                table[bytes(byte[c] for c in body) + (b" " if last else b"")] = i
                self.ends[i] = last
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=table, special_tokens={})._core_bpe

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in order."""
        odd = pc.match_substring_regex(words, _ODD)
        plain = words.filter(pc.invert(odd))
        one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py()
        pieces = pc.replace_substring_regex(pa.array(one.lower().split("\n"), pa.string()), f"(?:{_PIECES})", r"\0 ")
        data = "".join(pieces.to_pylist()) if len(plain) < 64 else _data(pieces)
        ids = np.frombuffer(self.merge.encode_to_tiktoken_buffer(data, set()), "<u4")
        stop = np.append(-1, np.flatnonzero(self.ends[ids]))[np.cumsum(pc.count_substring(pieces, " ").to_numpy())] + 1
        n = np.diff(stop[: len(plain)], prepend=0)
        if len(plain) == len(words):
            return n, ids
        other = self._library(words.filter(odd).to_pylist())
        which = odd.to_numpy(zero_copy_only=False)
        size, at = np.empty(len(words), "i8"), np.empty(len(words), "i8")
        size[~which], size[which] = n, [len(x) for x in other]
        at[~which], at[which] = np.cumsum(n) - n, len(ids) + np.cumsum([0, *(len(x) for x in other[:-1])])
        return size, _taken(np.concatenate([ids, *other]), at, size)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text (no nulls) has, and all ids in order."""
        if not len(texts):
            return np.zeros(0, "i8"), np.zeros(0, "<u4")
        if not self.own:
            got = self._library(texts.to_pylist())
            return np.array([len(x) for x in got]), np.concatenate(got)
        whole = pc.match_substring_regex(texts, self.whole)
        words = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        coded = words.flatten().dictionary_encode()
        n, ids = self._words(coded.dictionary)
        codes, bounds = coded.indices.to_numpy(), words.offsets.to_numpy().astype("i8")
        total = np.concatenate([[0], np.cumsum(n[codes])])
        sizes, flat = np.diff(total[bounds - bounds[0]]), _taken(ids, (np.cumsum(n) - n)[codes], n[codes])
        if pc.any(whole).as_py():
            at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            own = self._library(texts.filter(whole).to_pylist())
            cuts = np.cumsum(sizes)[at]  # these texts have no ids yet
            parts = np.split(flat, cuts)
            flat = np.concatenate([x for pair in zip(parts, [*own, np.zeros(0, "<u4")]) for x in pair])
            sizes[at] = [len(x) for x in own]
        return sizes, flat


def _data(a: pa.Array) -> str:
    """The values of a string array, one after the other."""
    bounds = np.frombuffer(a.buffers()[1], "<i4")[a.offset : a.offset + len(a) + 1]
    return a.buffers()[2][int(bounds[0]) : int(bounds[-1])].to_pybytes().decode()


def _taken(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, of these sizes from these places, one after the other."""
    stop = np.cumsum(size)
    return flat[np.repeat(at - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _MODELS:
        _MODELS[path] = WordTokenizer(path)
    return _MODELS[path]


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, none beyond its count, whose sum is largest within ``room``.

    Bit s of a layer is set when the lengths so far can sum to s. Counts are taken in binary
    parts, so a length adds a few shifts; the layers are walked back for the counts used.
    Longer lengths come first and the program stops as soon as the room is filled.
    """
    mask, layers, reach = (1 << (room + 1)) - 1, [], 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def minimum_bin_slack(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; together they use up ``counts``."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_fill({k: v for k, v in rest.items() if v}, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, uses in a pattern, first sequence, offset), by length and rank."""
    taken, rows, sequence = Counter(), [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, taken[length], pattern[length], sequence, offset))
            taken[length] += pattern[length] * times
            offset += length * pattern[length]
        sequence += times
    return np.array(sorted(rows), "i8").reshape(-1, 5)


def tokenized(docs: DataFrame, path: str, end_id: int, window: int, key: str, text: str) -> DataFrame:
    """Rows key, ids, task, whole (windows before, in the task), rank (of the remainder's length)."""

    def made(task, batches, seen, ranks):
        keys, texts = (pa.concat_arrays([b.column(c) for b in batches]) for c in ("key", "text"))
        sizes, flat = tokenizer(path)(texts.fill_null(""))
        sizes, ids = sizes + 1, np.insert(flat, np.cumsum(sizes), np.uint32(end_id))
        full, rest = np.divmod(sizes, window)
        order = np.argsort(rest, kind="stable")
        first = np.flatnonzero(np.diff(rest[order], prepend=-1))
        many = np.diff(np.append(first, len(order)))
        rank = np.empty(len(sizes), "i8")
        rank[order] = np.arange(len(order)) - np.repeat(first, many) + ranks[rest[order]]
        ranks[rest[order][first]] += many
        whole = seen + np.cumsum(full) - full
        bounds = np.concatenate([[0], 4 * np.cumsum(sizes)])
        for i in range(0, len(sizes), 1024):  # small batches for the writer
            j = min(len(sizes), i + 1024)
            part = ids[bounds[i] // 4 : bounds[j] // 4]
            blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bounds[i : j + 1] - bounds[i]).astype("<i4").tobytes()), pa.py_buffer(part.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [keys.slice(i, j - i), blobs, pa.array(np.full(j - i, task)), pa.array(whole[i:j]), pa.array(rank[i:j])], names=["key", "ids", "task", "whole", "rank"]
            )
        return seen + int(full.sum())

    def run(batches):
        task, whole, ranks = TaskContext.get().partitionId(), 0, np.zeros(window, "i8")
        for some in by_bytes(batches, TEXT_BYTES):
            whole = yield from made(task, some, whole, ranks)

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("task", "whole", "rank")])
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and the piece's ids."""
    spark = docs.sparkSession
    cut = written(tokenized(docs, path, end_id, window, key, text), "packing")
    size = F.octet_length("ids") / 4
    tally = cut.groupBy("task", (size % window).cast("long").alias("rest")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(size / window)).alias("full")
    )
    tally = written(tally, "packing-tally")
    histogram = {r.rest: r.n for r in tally.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # fewer than window rows
    patterns = minimum_bin_slack(histogram, window)
    table = slots(patterns)
    base = sum(t for _, t in patterns)
    ranks_before = tally.select(
        F.col("task").alias("t"), F.col("rest").alias("r"),
        (F.sum("n").over(Window.partitionBy("rest").orderBy("task")) - F.col("n")).alias("rank_before"),
    )
    # whole windows before a task: one row per task, summed in blocks of tasks so that no
    # window runs over all of them
    step = 4096
    per_task = tally.groupBy("task").agg(F.sum("full").alias("full")).withColumn("blk", F.floor(F.col("task") / step))
    blocks = per_task.groupBy("blk").agg(F.sum("full").alias("f"))
    blocks = blocks.select("blk", (F.sum("f").over(Window.orderBy("blk")) - F.col("f")).alias("before"))
    whole_before = per_task.join(F.broadcast(blocks), "blk").select(
        F.col("task").alias("t"),
        (F.col("before") + F.sum("full").over(Window.partitionBy("blk").orderBy("task")) - F.col("full")).alias("whole_before"),
    )
    # one row a task, at most window pairs of longs in it
    per_rest = ranks_before.groupBy("t").agg(F.collect_list(F.struct("r", "rank_before")).alias("rests"))
    placed = per_rest.join(whole_before.withColumnRenamed("t", "u"), F.col("t") == F.col("u")).drop("u")
    if tally.count() * 24 <= BROADCAST_BYTES:
        placed = F.broadcast(placed)
    shared = spark.sparkContext.broadcast(table)  # at most a few rows for each length and pattern

    def place(batches):
        t = shared.value
        for b in batches:
            rest, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "rank"))
            seq, off = np.zeros(len(rest), "i8"), np.zeros(len(rest), "i8")
            for length in np.unique(rest[rest > 0]):
                rows = t[np.searchsorted(t[:, 0], length) : np.searchsorted(t[:, 0], length, "right")]
                mine = np.flatnonzero(rest == length)
                s = rows[np.searchsorted(rows[:, 1], rank[mine], "right") - 1]
                turn, slot = np.divmod(rank[mine] - s[:, 1], s[:, 2])
                seq[mine], off[mine] = s[:, 3] + turn, s[:, 4] + slot * length
            yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names if c not in ("rest", "rank")] + [pa.array(seq), pa.array(off)], names=[c for c in b.schema.names if c not in ("rest", "rank")] + ["seq", "off"])

    ready = cut.withColumn("tokens", size.cast("long")).withColumn("rest", F.col("tokens") % window)
    ready = ready.join(placed, F.col("task") == F.col("t"))
    rank_before = F.element_at("rests.rank_before", F.array_position("rests.r", F.col("rest")).cast("int"))
    ready = ready.select("key", "ids", "tokens", "rest", (F.col("rank") + rank_before).alias("rank"), (F.lit(base) + F.col("whole") + F.col("whole_before")).alias("first"))
    schema = T.StructType([f for f in ready.schema.fields if f.name not in ("rest", "rank")] + [T.StructField("seq", T.LongType()), T.StructField("off", T.LongType())])
    ready = ready.mapInArrow(place, schema)
    pieces = ready.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / window).cast("long"))).alias("k"))
    start = F.col("k") * window
    is_whole = F.col("tokens") - start >= window
    return pieces.select(
        F.col("key").alias(key),
        start.alias("start"),
        F.least(F.lit(window), F.col("tokens") - start).cast("long").alias("length"),
        F.col("tokens").alias("doc_tokens"),
        F.when(is_whole, F.col("first") + F.col("k")).otherwise(F.col("seq")).alias("sequence_id"),
        F.when(is_whole, F.lit(0)).otherwise(F.col("off")).cast("long").alias("offset"),
        F.expr(f"substring(ids, cast(4 * k * {window} + 1 as int), {4 * window})").alias("ids"),
    )
