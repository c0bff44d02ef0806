"""Rows as protobuf messages: double time = 1, string partition_name = 2, repeated double state = 3.

The three fields are encoded by hand, in Arrow batches, so no schema compiler is needed.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..series import TIME

_TIME, _NAME, _STATE = 1 << 3 | 1, 2 << 3 | 2, 3 << 3 | 2  # field number and wire type


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def to_bytes(time: float, name: str, state: list[float]) -> bytes:
    text, values = name.encode(), struct.pack(f"<{len(state)}d", *state)
    return bytes([_TIME]) + struct.pack("<d", time) + bytes([_NAME]) + _varint(len(text)) + text + bytes([_STATE]) + _varint(len(values)) + values


def from_bytes(message: bytes) -> tuple[float, str, list[float]]:
    at, time, name, state = 0, 0.0, "", []

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = message[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(message):
        tag = varint()
        if tag & 7 == 1:
            value = struct.unpack_from("<d", message, at)[0]
            at += 8
            if tag >> 3 == 1:
                time = value
            elif tag >> 3 == 3:  # not packed
                state.append(value)
        elif tag & 7 == 2:
            n = varint()
            body, at = message[at : at + n], at + n
            if tag >> 3 == 2:
                name = body.decode()
            elif tag >> 3 == 3:
                state += struct.unpack(f"<{n // 8}d", body)
        elif tag & 7 == 0:
            varint()
        else:
            at += 4
    return time, name, state


def encode(long: DataFrame) -> DataFrame:
    """Adds ``message`` to rows of the long relation."""
    schema = T.StructType([*long.schema.fields, T.StructField("message", T.BinaryType())])

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (TIME, "partition_name", "state")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([to_bytes(*r) for r in rows], pa.binary())], names=[*b.schema.names, "message"])

    return long.mapInArrow(run, schema)


def decode(df: DataFrame) -> DataFrame:
    """``message`` as time, partition_name and state; other columns stay."""
    kept = [f for f in df.schema.fields if f.name != "message"]
    schema = T.StructType([*kept, T.StructField(TIME, T.DoubleType()), T.StructField("partition_name", T.StringType()), T.StructField("state", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            got = list(zip(*[from_bytes(m) for m in b.column("message").to_pylist()])) or [(), (), ()]
            cols = [pa.array(c, t) for c, t in zip(got, (pa.float64(), pa.string(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *cols], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
