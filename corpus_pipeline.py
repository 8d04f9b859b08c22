"""The corpus pipeline: five stages over ``documents``, each stored as Parquet before the next.

Every stage keeps the columns of documents but the last, which returns the
packed sequences.  Where a stage changes a text, ``n_chars`` is its new length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import jaccard, lines, packing, quality, suffix
from lintel.llm.common import prepare, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    prepare(spark)
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one up to one edit."""
    prepare(spark)
    return _counted(lines.dedup_lines(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five words, 0.8)."""
    prepare(spark)
    return jaccard.keep_one(docs, 5, 80, 100)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that also start earlier; broken characters go whole."""
    prepare(spark)
    return _counted(suffix.dedup_texts(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    prepare(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("suffix_dedup", suffix_dedup), ("best_fit_packing", pack)]

# The Jaccard components and the packing are not expressible in SQL; tests/llm
# holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
