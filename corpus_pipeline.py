"""Cleaning a training corpus in stages; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame.

Every stage but the last returns the columns of ``docs``. Texts and rows that a
stage drops or changes are dropped or changed for all later ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, jaccard, line_dedup, quality, sentencepieces

#: SQL cannot fit the classifier.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts; it is fitted on the rated rows of ``docs``."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rated_per_grade=6000)
    return quality.select(docs, model, least=0.6)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters that 5 documents share stay in one of them; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest id."""
    return jaccard.keep_smallest(docs, percent=75)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of ten benchmark words."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_share=0.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's piece ids, and what they decode to, as digests."""
    return sentencepieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; what a stage keeps is written in the shared folder and read by the next."""
    from spanloom.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
