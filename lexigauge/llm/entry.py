"""The registered queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_extract, packing, prefix_hash, quality, quotation, sentencepiece_bpe, simhash, suffix_dedup, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.format_chats(read(spark, sf_dir, "conversations"))


def quotation_of_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 where there is something to link: the given conversations with quotes put into them."""
    return quotation.format_chats(quotation.with_quotes(read(spark, sf_dir, "conversations")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edits(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality": op3_quality,
        "op4_quotation_chat": op4_quotation_chat,
        "quotation_of_replies": quotation_of_replies,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_packing": op6_packing,
        "op7_fingerprints": op7_fingerprints,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quotation_chat": quotation.SQL, "quotation_of_replies": quotation.QUOTED_SQL, "op5_embedding_near_dedup": embedding_dedup.SQL}
