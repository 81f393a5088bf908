"""A corpus from documents to a training mix: five stages, each over all that the one before it kept."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.llm import decontaminate, mixing, ngram_join, pii, quality
from loomlens.llm.scratch import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score 0.5 or more). Null and empty texts score as the model's
    intercept does; without labels nothing is rejected. Repeated rows stay, and an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    weights = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, weights)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest id, null
    last; of repeated rows one. Null, empty and blank texts are in no group and all stay."""
    return ngram_join.keep_one_of_each(docs.select(*COLUMNS), 5, Fraction(4, 5))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, their columns and repeats as they were; null and empty texts hold none."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars that of the new text; null texts stay null."""
    return pii.redact_personal_data(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted; 0 of null and empty texts. A row for each of docs."""
    return mixing.mix_sources(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each), ("decontamination", drop_leaks), ("personal_data", hide_personal_data), ("mixing", mix)]
#: A trained classifier, a random walk and rounding by hash have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
