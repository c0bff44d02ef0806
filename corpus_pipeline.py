"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and
returns documents with their columns; the last returns packed pieces. Nothing is sampled or
capped. Null texts fail the quality rules; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm._util import discard, table, written
from tidewheel.llm.decontaminate import contamination, is_contaminated
from tidewheel.llm.jaccard import jaccard_components
from tidewheel.llm.packing import pack
from tidewheel.llm.pii import redact
from tidewheel.llm.quality import quality
from tidewheel.llm.queries import END_ID, WINDOW, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does. Null and empty texts fail;
    repeated rows are judged, and stay, each; a null host gets no verdict; columns of any name
    come through as they are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    kept = quality(plain, names["text"], names["source"], keep_text=True).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, which tells rows apart whatever their ids; written, so that it holds."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the least id, null last. Rows are told apart by more than
    their ids, so only copies go; of rows without words, those that repeat an id and its text.
    Other columns are carried."""
    rows = _numbered(docs)
    blank = F.when(~F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.col("text")).alias("blank")
    found = jaccard_components(rows, key="__row").join(rows.select("__row", "doc_id", blank), "__row")
    wordless = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~wordless, F.col("component_id")), F.when(wordless, F.col("doc_id")), F.when(wordless, F.col("blank"))]
    least = F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("__row")
    first = found.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(least).select("__row")
    return rows.join(first, "__row", "leftsemi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth. Rows are judged each,
    whatever their ids; null and empty texts hold no window and stay; other columns are carried."""
    rows = _numbered(docs)
    hit = contamination(rows, table(spark, sf_dir, "benchmark"), key="__row").where(is_contaminated()).select("__row")
    return rows.join(hit, "__row", "leftanti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind's name; null texts stay null,
    ``n_chars`` follows the text, other columns are carried."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with the checksum of their ids. Null texts are
    empty; repeated rows are packed each; other columns are not read."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), WINDOW, END_ID).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The tokenizer has no SQL; tests hold the stages against plain-Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
