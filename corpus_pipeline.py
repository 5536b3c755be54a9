"""A corpus pipeline of five stages over documents.

run(spark, sf_dir) applies STAGES in order. Each stage works on what the one
before kept, is written as Parquet and read again, so a lost executor never
costs more than the stage at hand. All but the last return the columns of
documents; the last returns the pieces of documents with their places in
training sequences.

Defined cases are those of the operators: null and empty texts score as clean,
fail the quality rules' least number of words and so go there; equal rows count
as one group of near duplicates; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.common import bounded_batches, materialise, remove_path, table
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import pack_documents


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7."""
    bounded_batches(spark)
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    bounded_batches(spark)
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines found in ten or more; n_chars counts what is left."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__line_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bounded_batches(spark)
    return one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    bounded_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name, paths)
        if len(paths) > 1:  # what the stage before wrote has been read
            remove_path(spark, paths.pop(0))
    return STAGES[-1][1](spark, docs, sf_dir)
