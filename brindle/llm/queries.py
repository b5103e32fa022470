"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import cap_filters, chat_format, conv_classifier, cotrain, divergence, hash_tree, lsh_forest, mixing, pattern_pack, wacz
from brindle.llm.common import table

#: A conversation whose texts look like markup, formatted with the others.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    chats = chat_format.format_chats(turns.unionByName(extra))
    read = chats.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("pieces"), F.col("loss_mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.jaccard_classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_verdicts(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, ceiling=2.0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wacz.write_archives(table(spark, sf_dir, "pages"), wacz.archive_folder(spark))
    return wacz.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = conv_classifier.score_toxicity(docs, conv_classifier.fit_toxicity(docs, labels))
    held_out = F.coalesce(conv_classifier.bucket(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return cotrain.score_quality(docs, cotrain.fit_quality(docs, labels))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_embedding_dedup, op3_jaccard_join, op4_quality_rules, op5_mixing, op6_sharding, op7_warc, op8_toxicity, op9_quality_classifier, op10_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), placed AS (
            SELECT *, lag(role) OVER w IS DISTINCT FROM role AS first,
                   replace(replace(replace(replace(text, '\', '\s'), '<turn', '\lturn'), '</turn', '\l/turn'), '<part', '\lpart') AS escaped,
                   replace(replace(replace(replace(replace(role, '\', '\s'), '<turn', '\lturn'), '</turn', '\l/turn'), '<part', '\lpart'), '>', '\g') AS name
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               -- a block: '<turn NAME>' newline, texts joined by '<part/>', '</turn>' newline
               sum(length(escaped) + CASE WHEN first THEN 8 + length(name) + 8 ELSE 7 END)::BIGINT AS formatted_chars,
               count(*) FILTER (first) AS n_blocks
        FROM placed GROUP BY conv_id
    """,
    "op4_quality_rules": divergence.verdicts_sql(),
    "op7_warc": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM firsts
    """,
}
