"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, one string:

    conversation = turn*
    turn = "<s>[" role "] " body " [/" role "]</s>"

``role`` is percent-encoded, so it holds no bracket. Inside a body ``<s>``, ``</s>``,
``[x]`` and ``[/x]`` are escaped by one backslash after the bracket; a string that already
has backslashes there gets one more, so unescaping is exact. Turns with ``<s>``, ``</s>``,
``[INST]`` or ``[/INST]`` are always escaped. The parser then reads the result back, and
other turns that differ from their source are escaped until the two agree.

Defined results: null text or role is empty; turns are ordered by turn, then role, then text,
nulls first, so ties and repeated rows keep every row in a fixed order; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches

_CONTROL = r"(?=/?s>|/?[A-Za-z0-9%_.~-]*\])"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_FIXED = re.compile(r"<\\*/?s>|\[\\*/?INST\]")
_HEAD = re.compile(r"<s>\[([A-Za-z0-9%_.~-]*)\] ")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns as (role, text, start and end of the body); ValueError outside the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        close = f" [/{head[1]}]</s>"
        end = formatted.find(close, head.end())
        if end < 0:
            raise ValueError(f"turn at {at} has no end")
        turns.append((unquote(head[1]), unescape(formatted[head.end() : end]), head.end(), end))
        at = end + len(close)
    return turns


def masked(formatted: str, spans: list[list[int]]) -> list[str]:
    """The texts under a mask of a formatted string, unescaped."""
    return [unescape(formatted[a:b]) for a, b in spans]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The formatted string and its turns as the parser reads them back."""
    safe = [bool(_FIXED.search(text)) for _, text in turns]
    while True:
        parts = []
        for (role, text), escaped in zip(turns, safe):
            r = quote(role, safe="")
            parts.append(f"<s>[{r}] {escape(text) if escaped else text} [/{r}]</s>")
        formatted = "".join(parts)
        try:
            back = parse(formatted)
        except ValueError:
            back = []
        if [x[:2] for x in back] == turns:
            return formatted, back
        # each part alone tells which turns conflict; if none does, escape all
        conflicts = []
        for part, turn in zip(parts, turns):
            try:
                conflicts.append([x[:2] for x in parse(part)] != [turn])
            except ValueError:
                conflicts.append(True)
        grown = [a or c for a, c in zip(safe, conflicts)]
        if grown == safe:
            if all(safe):
                raise ValueError("the conversation doesn't survive the round trip")
            grown = [True] * len(turns)
        safe = grown


OUTPUT = T.StructType(
    [
        T.StructField("formatted", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("loss_texts", T.ArrayType(T.StringType())),
    ]
)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its key, the formatted string, and as read back from it the
    roles, the texts, the code-point spans of the string that carry loss, and the texts under
    those spans. A conversation is one string, so its turns meet in one row."""
    bounded_batches(rows.sparkSession)
    grouped = rows.groupBy(F.col(conv).alias("key")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))).alias("turns")
    )
    key = T.StructField("key", rows.schema[conv].dataType)

    def run(batches):
        for b in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            masks = [[[t[2], t[3]] for t in back if t[0] == loss_role] for _, back in made]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key"),
                    pa.array([f for f, _ in made], pa.string()),
                    pa.array([[t[0] for t in back] for _, back in made], pa.list_(pa.string())),
                    pa.array([[t[1] for t in back] for _, back in made], pa.list_(pa.string())),
                    pa.array(masks, pa.list_(pa.list_(pa.int32()))),
                    pa.array([masked(f, m) for (f, _), m in zip(made, masks)], pa.list_(pa.string())),
                ],
                names=["key", *OUTPUT.names],
            )

    return grouped.mapInArrow(run, T.StructType([key, *OUTPUT.fields])).withColumnRenamed("key", conv)
