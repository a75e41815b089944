"""Language filter, near-duplicate removal, decontamination, sanitising and mixing of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.decontaminate import drop_contaminated
from opsframe.llm.jaccard import keep_one_of_each
from opsframe.llm.langid import fit_language_model, keep_identified
from opsframe.llm.mixing import fair_mix
from opsframe.llm.pii import sanitise
from opsframe.llm.queries import fold
from opsframe.llm.stages import small_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network names with a probability of a half or more."""
    small_batches(spark)
    return keep_identified(docs, fit_language_model(docs, ~fold(4, 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over five-word shingles."""
    small_batches(spark)
    return keep_one_of_each(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced; ``n_chars`` follows the text."""
    small_batches(spark)
    return sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes of each document."""
    small_batches(spark)
    return fair_mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mix", mix)]

#: The network, the joins by hash order and the tiling have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
