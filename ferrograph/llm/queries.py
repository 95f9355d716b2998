"""The registered queries of this subpackage, and their SQL for the checking database."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.llm import chat, contamination, exact_dedup, language_id, lm_score, ngram_join, pieces, secret_scan, suffix_dedup, warc
from ferrograph.llm.shared import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def tokenizer(name: str = "piece_bpe_32k.model") -> bytes:
    """The bytes of a public tokenizer file, read on the driver; FERROGRAPH_TOKENIZERS names another folder."""
    folder = os.environ.get("FERROGRAPH_TOKENIZERS", "")
    if not folder:
        import public_tokenizers

        return Path(public_tokenizers.path(name)).read_bytes()
    return (Path(folder) / name).read_bytes()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"), language_id.fold("doc_id", 7) == 2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no times: a capture a second, in order of page_id
    when = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)))
    pages = table(spark, sf_dir, "pages").withColumn("captured", when)
    index = warc.archived(pages, least_bytes=100)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"), owner="source", example_owners=3)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.fold() == 1
    model = language_id.train(docs.filter(~held))
    return language_id.identify(docs, model).withColumn("held_out", held)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_sentencepiece, op3_decontamination, op4_lm_scoring, op5_warc, op6_secret_scans, op7_suffix_array_dedup, op8_language_id, op9_chat_formatting, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": ngram_join.ORACLE, "op3_decontamination": contamination.ORACLE, "op5_warc": warc.ORACLE, "op9_chat_formatting": chat.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
