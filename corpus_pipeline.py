"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents. Each result is written as Parquet before the next stage reads it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinkweave.llm import bpe, decontaminate, pii, resemblance, toxicity
from sinkweave.llm.common import cut, table

#: Rows go to and from Python workers in batches of so many bytes: by rows alone (10,000) a batch of texts has
#: up to 64 MB, and what the workers of one stage took stays with the executor in the next.
BATCH_BYTES = 2 << 20


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five words stays, that with the smallest id."""
    return resemblance.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; ``n_chars`` follows the text."""
    out = pii.replace(docs, pii.key_of(spark)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text that they decode to."""
    return bpe.digest(docs)


def in_small_batches(stage):
    """``stage`` in a session whose Arrow batches have BATCH_BYTES at most. Results are read later, so the setting stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", in_small_batches(civil)),
    ("near_dedup", in_small_batches(distinct_enough)),
    ("decontamination", in_small_batches(uncontaminated)),
    ("pii", in_small_batches(without_personal_data)),
    ("bpe", in_small_batches(encoded)),
]

#: SQL can express neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
