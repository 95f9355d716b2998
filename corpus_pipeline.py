"""From raw documents to tokenised training documents, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept:

1. language_id: rows without letters, or whose language is in doubt, go.
2. exact_dedup: of rows whose texts are equal but for white space, the longest (then the smallest doc_id) stays.
3. near_dedup: of the documents that are connected by 5-word shingle similarity of 0.8 or more, the smallest doc_id stays.
4. decontaminate: documents that contain a benchmark item go.
5. sentencepiece: what remains is encoded, and decoded again.

No stage but the last changes columns. Empty tables pass through; rows without a doc_id are kept by stages 3 and 4,
which decide by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrograph.llm import contamination, exact_dedup, language_id, ngram_join, pieces
from ferrograph.llm.queries import tokenizer
from ferrograph.llm.shared import saved, ship, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.accepted(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    ship(spark)
    return pieces.round_trip(docs, tokenizer(), texts=True).drop("decoded")


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", decontaminate),
    ("sentencepiece", tokenise),
]
#: Stages 1 and 5 can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else saved(docs, name), sf_dir)
    return docs
