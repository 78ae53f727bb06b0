"""A corpus pipeline of five stages: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's documents.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiretide.llm import decontamination, language_id, queries, simhash, span_dedup
from hiretide.llm.common import fold, small_batches
from hiretide.operators.scratch import materialise


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from three quarters of those that carry one."""
    small_batches(spark)
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    return language_id.identified_only(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the sentences of passages that an earlier one holds; n_chars follows the text."""
    small_batches(spark)
    out = span_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    small_batches(spark)
    return decontamination.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in a sequence."""
    small_batches(spark)
    return queries.packed(docs)


STAGES = [
    ("language_id", identified),
    ("simhash", distinct),
    ("span_dedup", unrepeated),
    ("decontamination", uncontaminated),
    ("packing", sequences),
]

#: SQL has neither the trained model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
