"""Five stages from raw documents to token ids.

Quality rules, near duplicates, decontamination and masking of personal data keep the columns of `documents`; the last
stage encodes what is left. Each stage's rows are written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagspark.llm import bpe, decontaminate, near_copies, pii, quality, simhash
from tagspark.llm.queries import pattern, table, vocabulary
from tagspark.sources.sinks import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the thresholds of their language and source. Null texts have no words and go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, and no other.

    Rows are linked by fingerprints of at most two differing bits (three-word shingles), and by sets of five-word shingles of
    a similarity of at least 0.8, which fingerprints miss. Null texts are empty; all texts without words are one group.
    Rows without a doc_id give way to those with one. Of rows that repeat id and text one stays. A table without rows gives none.
    """
    return simhash.one_of_each(docs, links=near_copies.links(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with a benchmark item. The others keep their whole text.

    Null and empty texts have no words and stay; repeated rows are judged each.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked. A null text stays null, an empty one empty."""
    return pii.redacted(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of all documents."""
    return bpe.encoded(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL has no byte-level BPE, nor boosted trees; tests/llm holds the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
