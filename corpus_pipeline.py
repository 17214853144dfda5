"""The corpus pipeline: five stages over ``documents``, each one operator of the training-data subpackage.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last one
returns the packed pieces.  Between stages the documents are written as Parquet and read again, so a lost executor
costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import decontaminate, langid, packing, pii, simhash
from growthlens.llm.common import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language, whatever the score of the others: short and mixed texts may be clean.

    Documents without ``lang`` get the language that the network tells; all rows are judged by their text alone.
    """
    return langid.keep_known(docs, 0.0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component, the one of the least doc_id; texts without words are one group."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document with a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows the new text."""
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return pii.redact(docs).withColumn("n_chars", length)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; a NULL or empty text is its end mark alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", redaction),
    ("packing", sequence_packing),
]

#: SQL cannot express the language model or the packing search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
