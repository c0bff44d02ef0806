"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table

WINDOW, END_ID = 2048, 1
TOKEN_LIMIT = 4096
SHARD_BYTES = 1 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), WINDOW, END_ID).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii, joined, of_kind

    base = F.filter("pii", lambda s: s["kind"].isin(*KINDS[:4]))
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[of_kind(F.col("pii"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, is_contaminated

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import extendible

    rows, _ = extendible(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)
    return rows.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "n_rows", "fits")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = format_chats(rows.unionByName(extra))
    turns = F.concat_ws("", F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t.roles, F.lit("\n"), t.texts, F.lit("\n"))))
    loss = F.concat_ws("", "loss_texts")
    return made.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read_records

    index, folder = archive(table(spark, sf_dir, "pages"))
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_chat": op3_chat,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_jaccard": op9_jaccard,
    "op10_substrings": op10_substrings,
}

ORACLE = {
    "op4_decontaminate": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
        z AS (SELECT DISTINCT n FROM i),
        g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, z)),
        h AS (SELECT doc_id, s, g.n, item_id FROM g JOIN i ON g.win = i.win AND g.n = i.n),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_sharding": """
        WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
        p AS (SELECT *, d, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(h), 60, '0'), 60)[1:d] END AS b FROM r, range(0, 41) AS t(d)),
        s AS (SELECT d, b, sum(n_bytes) AS x, count(*) AS n FROM p GROUP BY d, b),
        f AS (SELECT doc_id, n_bytes, min(p.d) AS depth FROM p JOIN s ON p.d = s.d AND p.b = s.b WHERE x <= 1048576 OR n = 1 GROUP BY doc_id, n_bytes)
        SELECT f.doc_id, CAST(f.n_bytes AS BIGINT) AS n_bytes, p.b AS shard, CAST(f.depth AS INTEGER) AS depth, CAST(x AS BIGINT) AS shard_bytes, n AS n_rows, x <= 1048576 AS fits
        FROM f JOIN p ON f.doc_id = p.doc_id AND f.depth = p.d JOIN s ON s.d = p.d AND s.b = p.b""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM q)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN kept = page_id THEN NULL ELSE kept END AS refers_to
        FROM r""",
    "op5_quality": r"""
        WITH w AS (
            SELECT doc_id, source, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS ls
            FROM documents),
        g AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
        k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
        c AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) AS o(d) WHERE c > 1 GROUP BY doc_id),
        s AS (
            SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
                   CAST(length(regexp_replace(t, '[ \t\n\v\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM w LEFT JOIN c USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
        h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
        m AS (SELECT sum(x) / sum(n) AS m, coalesce(var_pop(x / n), 0) AS v FROM h),
        b AS (SELECT m, CASE WHEN v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) END AS w FROM m),
        r AS (SELECT source, (x + w * m) / (n + w) > 0.5 AS bad FROM h, b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(bad, FALSE) AS kept
        FROM f LEFT JOIN r USING (source)""",
    "op3_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?[A-Za-z0-9%_.~-]*\])', '\1\\\2\3', 'g') AS safe FROM c),
        g AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
                   CAST(sum(length(CASE WHEN regexp_matches(text, '<\\*/?s>|\[\\*/?INST\]|[<\[]\\+(/?s>|/?[A-Za-z0-9%_.~-]*\])') OR contains(text, ' [/' || role || ']</s>') THEN safe ELSE text END) + 2 * length(role) + 14) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g""",
}
