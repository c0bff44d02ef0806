"""Quality rules with host verdicts.

Rule statistics are taken per document. Failures are summed by host, each host's failure
rate is shrunk towards the corpus with a beta prior fitted to the hosts' rates by moments,
and the host's verdict is joined back: a document goes when it fails a base rule itself or
when its host's shrunk failure rate is above ``host_limit``, by default one half: more of the
host's documents are expected to fail than to pass.

Defined results: null text has no words, fails the word-count rule; rows with a null host
form no host and get no host verdict; repeated rows count as they come; an empty table gives
an empty result; extra columns of the input are carried through unless they have the name of
an output, which then replaces them.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, written

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits on exactly space and \t..\r
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen, last = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeats += i + 3 - max(i, last)
                last = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def with_stats(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the rule statistics as columns, and with the text only if asked."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if (keep_text or c != text) and c not in STATS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(s, T.LongType()) for s in STATS])

    def run(batches):
        for b in batches:
            rows = [text_stats(x) for x in b.column("__text").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in cols], names=[*keep, *STATS]
            )

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def base_failed(min_words: int = 50, repeat_percent: int = 50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_verdicts(rated: DataFrame, host: str, failed: str, host_limit: float, weights: tuple[float, float]) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict.

    The beta prior is fitted by moments over hosts: with mean m and variance v of the raw
    rates, its weight in documents is m(1-m)/v - 1, kept between ``weights``: at least the
    first, so that a host of a few documents isn't judged by them alone, and at most the
    second, as where the rates agree, so that a host's own documents always count.
    """
    hosts = written(
        rated.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(
            F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed")
        ),
        "hosts",
    )
    rate = F.col("host_failed") / F.col("host_docs")
    m, v = hosts.agg(F.sum("host_failed") / F.sum("host_docs"), F.var_pop(rate)).first()  # one row
    m, v = m or 0.0, v or 0.0
    w = weights[1] if v <= 0 else min(weights[1], max(weights[0], m * (1 - m) / v - 1))
    shrunk = (F.col("host_failed") + w * m) / (F.col("host_docs") + w)
    return hosts.select("__host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk > host_limit).alias("host_bad"))


def quality(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5, keep_text: bool = False, weights: tuple[float, float] = (1.0, 1000.0)) -> DataFrame:
    """Statistics, ``base_failed``, ``host_rate`` and ``kept`` for every row.

    Host failures are pre-aggregated, so a host with a third of all rows is a few partial
    sums. Verdicts are joined back on the host, a left join that adaptive execution may
    broadcast or split. Without the text the statistics are written once; with it they are
    taken again in the second pass, which costs less than a second copy of the texts.
    """
    rated = with_stats(docs.drop("base_failed", "host_rate", "kept", "host_bad", "host_docs", "host_failed"), text, keep_text).withColumn("base_failed", base_failed())
    if not keep_text:
        rated = written(rated, "quality")
    verdicts = host_verdicts(rated, host, "base_failed", host_limit, weights)
    return (
        rated.join(verdicts, F.col(host) == F.col("__host"), "left")
        .drop("__host", "host_docs", "host_failed")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_bad", F.lit(False)))
        .drop("host_bad")
    )
