"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Defined results: documents have the columns doc_id, text, lang, source and n_chars; others, whatever their
names, go along unchanged to the last stage, which has its own columns. A null or empty text has too few
words and leaves with the first stage. Rows without an id are judged by their texts like any others; a null
source is a source of its own; lang and n_chars may be null. Of equal rows with an id one stays, of equal
rows without an id all do. Very long texts are worked on whole in every stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from temblor.llm import decontaminate, minhash, mixing, quality_rules, token_output
from temblor.llm.common import stored, table

#: A trained vocabulary and pseudorandom draws are part of the stages, which SQL cannot express.
ORACLE_SQL = None
#: Percent of shared shingles; op9's own contract asks for 85.
NEAR_DUPLICATE = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the strict policy rejects."""
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each near-duplicate component."""
    return minhash.kept_documents(docs, NEAR_DUPLICATE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the files of token ids hold, read back."""
    return token_output.encode_and_read(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
