"""WARC archives with an index, read back by coalesced byte ranges.

Pages with the same payload digest (of at least ``least`` bytes) are stored once, under the
largest key; the others become revisit records that refer to it. Each task writes one
archive of gzip members in the shared folder, one member a record, and emits an index row
per record: file, offset, length, URL, digest. The index is a table that Spark commits, so
an archive left by a lost attempt is never referred to. Reading sorts the selected index
rows by file and offset, joins ranges that lie close together into one read, and takes
each record from its bytes alone.

Defined results: null payloads are empty and null URLs are empty; repeated rows of a key are
written each, and when equal they are all responses under that key, since a record doesn't
revisit its own key; a null key is written and is never a target; an empty table gives an
empty index. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BROADCAST_BYTES, bounded_batches, scratch_path, written

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
_DATE = "2024-01-01T00:00:00Z"  # archives of equal pages are equal


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def record_id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member. A revisit holds no payload but its length and digest."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {url}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def deduplicated(pages: DataFrame, key: str, url: str, payload: str, least: int) -> DataFrame:
    """Rows page_id, url, payload, digest, refers_to.

    Only keys and digests are aggregated and joined, so the copies of a very common page are
    slim rows. What a page refers to then meets its payload by page, a key that is never hot;
    that side is broadcast behind a count, so as a rule no payload is shuffled."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\\r\\n]", " ").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    slim = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    kept = slim.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "kept")
    refers = slim.join(kept, F.col("digest") == F.col("d")).where(F.col("kept") != F.coalesce("page_id", F.col("kept") - 1))
    refers = written(refers.select(F.col("page_id").alias("p"), "d", F.col("kept").alias("refers_to")).distinct(), "warc-refers")
    if refers.count() * 128 <= BROADCAST_BYTES:
        refers = F.broadcast(refers)
    return rows.join(refers, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write records and return the committed index."""

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, at, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for b in batches:
                index = []
                out = out or fs.open_output_stream(name, compression=None)
                for r in b.to_pylist():
                    member = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    out.write(member)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    index.append((name, at, len(member), r["page_id"], r["url"], r["digest"], kind, r["refers_to"]))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                        names=["file", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"],
                    )
        finally:
            if out:
                out.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def coalesced(rows: list[dict], gap: int, most: int) -> list[list[dict]]:
    """Index rows, sorted by offset, in runs that one read each fetches."""
    runs: list[list[dict]] = []
    for r in rows:
        last = runs[-1] if runs else None
        if last and r["file"] == last[-1]["file"] and r["offset"] - (last[-1]["offset"] + last[-1]["length"]) <= gap and r["offset"] + r["length"] - last[0]["offset"] <= most:
            last.append(r)
        else:
            runs.append([r])
    return runs


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The selected records: their header fields and payload (null for revisits). Ranges of
    records are dealt out by place, to at least as many tasks as there are archives, and to
    one for each ``task_bytes`` that are to be read."""
    files, size = index.agg(F.count_distinct("file"), F.sum("length")).first()
    tasks = max(1, files, -(-(size or 0) // task_bytes))

    def run(batches):
        fs, _ = filesystem(folder)
        name, handle = None, None
        for b in batches:
            for part in coalesced(b.to_pylist(), gap, most):
                if part[0]["file"] != name:
                    if handle:
                        handle.close()
                    name = part[0]["file"]
                    handle = fs.open_input_file(name)
                start = part[0]["offset"]
                handle.seek(start)
                data = handle.read(part[-1]["offset"] + part[-1]["length"] - start)
                got = []
                for r in part:
                    fields, block = parse_record(data[r["offset"] - start : r["offset"] - start + r["length"]])
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"record at {start} of {name} has another digest")
                    num = lambda s: int(s[len("<urn:x-page:") : -1]) if s and s != "<urn:x-page:>" else None
                    got.append((num(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], digest, int(fields["X-Payload-Length"]) if revisit else len(block), num(fields.get("WARC-Refers-To")), None if revisit else block))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"],
                )
        if handle:
            handle.close()

    chosen = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> tuple[DataFrame, str]:
    """Write ``pages`` as archives; the index and the folder."""
    spark: SparkSession = pages.sparkSession
    bounded_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    return write_archives(deduplicated(pages, key, url, payload, least), folder), folder
