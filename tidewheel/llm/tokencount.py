"""Token counts from pre-token frequencies.

A document's tokens are counted without ids: pieces are counted once per distinct pre-token
of the corpus, and joined to the frequency of each pre-token in each document.

No piece of the vocabulary holds a space mark after another character or a line feed, so a
run of spaces with what follows up to the next space or line feed encodes on its own, and a
line feed is always one piece. ``check_vocabulary`` refuses a model for which that fails.

Rows travel packed. A block is the documents of about ``block_bytes`` of text. It sends its
distinct pre-tokens, once each, to the bucket of their hash, and keeps each document's
frequencies as arrays of (place, count). A bucket counts the pieces of each distinct
pre-token once and answers every block with an array of counts in the order asked. So no
shuffle carries a row per word, a hot pre-token is one entry per block, and memory is bounded
by a block, or by what a bucket keeps. Buckets grow with the input up to 4,096, since each
block sends a row to each; beyond that a bucket forgets when it holds ``keep`` pre-tokens.

Defined results: null or empty text has no tokens; repeated rows are counted each; an empty
table gives an empty result; columns other than the key and the text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, partitions, written

_MODELS: dict = {}
#: A line feed; spaces with what follows them; spaces that end a line.
_PRETOKEN = re.compile(r"\n| *[^ \n]+| +")


def model(path: str):
    """The sentencepiece model, loaded once per process."""
    if path not in _MODELS:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        check_vocabulary(m)
        _MODELS[path] = m
    return _MODELS[path]


def check_vocabulary(m) -> None:
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if "▁" in p.lstrip("▁") or "\n" in p:
            raise ValueError(f"piece {p!r} crosses pre-tokens; this model needs whole texts")
    if len(m.encode("\n")) != 2 or len(m.encode("a\n  b")) != len(m.encode("a")) + 1 + len(m.encode("\n  b")) - 2:
        raise ValueError("the model merges line feeds; it needs whole texts")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text as the model sees it, with the space that it puts in front."""
    return _PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


def count_pieces(m, tokens: list[str]) -> np.ndarray:
    """Pieces of each pre-token: behind a line feed, which is two pieces with the dummy space."""
    n = [len(x) - 2 for x in m.encode(["\n" + t for t in tokens], num_threads=1)]
    return np.array([1 if t == "\n" else k for t, k in zip(tokens, n)], "<u4")


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    a = np.ascontiguousarray(a, "<u4")
    return len(a).to_bytes(8, "little") + zstandard.compress(a.view("u1").reshape(-1, 4).T.tobytes(), 1)


def _loosen(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = zstandard.decompress(b[8:], max_output_size=max(1, 4 * n))
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, n).T).view("<u4").reshape(n)


class _Block:
    """Documents of one block: their keys, sizes and frequencies over the block's vocabulary."""

    def __init__(self):
        self.vocab, self.keys, self.sizes, self.freq, self.bytes = {}, [], [], [], 0

    def add(self, key, text):
        n = len(text.encode()) if text else 0
        seen, vocab = Counter(pretokens(text or "")), self.vocab
        ids = np.fromiter((vocab.setdefault(t, len(vocab)) for t in seen), "i8", len(seen))
        self.freq.append((ids, np.fromiter(seen.values(), "u4", len(seen))))
        self.keys.append(key)
        self.sizes.append(n)
        self.bytes += n + 64

    def close(self, n_buckets):
        """Frequencies by place in the order of buckets, and what each bucket is asked."""
        asks = [[] for _ in range(n_buckets)]
        which, place = np.empty(len(self.vocab), "i8"), np.empty(len(self.vocab), "i8")
        for t, i in self.vocab.items():
            a = asks[b := crc32(t.encode()) % n_buckets]
            which[i], place[i] = b, len(a)
            a.append(t)
        place += np.concatenate([[0], np.cumsum([len(a) for a in asks])])[which]
        gaps, counts = [], []
        for ids, n in self.freq:
            at = place[ids]
            order = np.argsort(at)
            gaps.append(np.diff(at[order], prepend=0))
            counts.append(n[order])
        cat = lambda xs: _squeeze(np.concatenate(xs) if xs else np.empty(0))
        return [_squeeze(np.array([len(i) for i, _ in self.freq])), cat(gaps), cat(counts)], asks


def _asked(key_type, n_buckets, block_bytes):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.list_(pa.string())), ("keys", pa.list_(key_type)), ("sizes", pa.list_(pa.int64())), ("parts", pa.list_(pa.binary()))])

    def out(block, number):
        parts, asks = block.close(n_buckets)
        yield pa.RecordBatch.from_pylist([{"block": number, "bucket": -1, "keys": block.keys, "sizes": block.sizes, "parts": parts}], schema)
        rows = [{"block": number, "bucket": b, "tokens": a} for b, a in enumerate(asks) if a]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[i : i + 64], schema)

    def run(batches):
        block, number = _Block(), TaskContext.get().partitionId() << 32
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                block.add(key, text)
                if block.bytes >= block_bytes:
                    yield from out(block, number)
                    block, number = _Block(), number + 1
        if block.keys:
            yield from out(block, number)

    return run


def _answered(model_path, keep):
    """Counts of the pre-tokens that blocks ask for; each distinct one is encoded once here,
    or once for every ``keep`` distinct ones where a bucket has more, so that memory is bounded."""

    def run(batches):
        m, known = model(model_path), {}
        for b in batches:
            got = []
            for tokens in b.column("tokens").to_pylist():
                if len(known) > keep:
                    known = {}
                if new := [t for t in tokens if t not in known]:
                    known.update(zip(new, count_pieces(m, new).tolist()))
                got.append(_squeeze(np.array([known[t] for t in tokens])))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(got, pa.binary())], names=["block", "bucket", "counts"])

    return run


def _summed(key_type):
    names = ["key", "n_bytes", "n_tokens"]

    def done(own, counts):
        pieces = np.concatenate([_loosen(c) for c in counts]) if counts else np.empty(0, "u4")
        lens, gaps, n = (_loosen(p).astype("i8") for p in own["parts"])
        ends = np.cumsum(lens)
        steps = np.cumsum(gaps)  # a document's gaps start anew from 0
        base = np.concatenate([[0], steps])[ends - lens]
        total = np.concatenate([[0], np.cumsum(pieces[steps - np.repeat(base, lens)].astype("i8") * n)])
        return pa.RecordBatch.from_arrays([pa.array(own["keys"], key_type), pa.array(own["sizes"], pa.int64()), pa.array(total[ends] - total[ends - lens], pa.int64())], names=names)

    def run(batches):
        own, counts = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] < 0:
                    if own:
                        yield done(own, counts)
                    own, counts = row, []
                else:
                    counts.append(row["counts"])
        if own:
            yield done(own, counts)

    return run


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", block_bytes: int = 16 << 20, keep: int = 1 << 20) -> DataFrame:
    """Columns key, n_bytes (UTF-8) and n_tokens for every row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    arrow = to_arrow_type(kind)
    n_buckets = min(4096, max(16, 2 * partitions(docs)))
    asked = written(
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
            _asked(arrow, n_buckets, block_bytes),
            T.StructType(
                [
                    T.StructField("block", T.LongType()),
                    T.StructField("bucket", T.IntegerType()),
                    T.StructField("tokens", T.ArrayType(T.StringType())),
                    T.StructField("keys", T.ArrayType(kind)),
                    T.StructField("sizes", T.ArrayType(T.LongType())),
                    T.StructField("parts", T.ArrayType(T.BinaryType())),
                ]
            ),
        ),
        "tokencount",
    )
    answers = (
        asked.where("bucket >= 0").select("block", "bucket", "tokens").repartition(n_buckets, "bucket")
        .mapInArrow(_answered(model_path, keep), "block long, bucket int, counts binary")
    )
    both = asked.where("bucket < 0").select("block", "bucket", "keys", "sizes", "parts").unionByName(answers, allowMissingColumns=True)
    return (
        both.repartition("block").sortWithinPartitions("block", "bucket")
        .mapInArrow(_summed(arrow), T.StructType([T.StructField("key", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
        .withColumnRenamed("key", key)
    )
