"""A corpus from raw documents: quality, near-duplicates, decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet before the next
stage reads it. All but the last return the columns of documents.

- quality: documents that a rule rejects go, so do NULL and empty texts.
- near_duplicates: of each class of near copies the document with the smallest id stays.
- decontaminate: documents with a window of ten words of a benchmark item go.
- secrets: secrets are replaced by a mark; n_chars follows the new text. All documents stay.
- mix: sources are mixed by weights 1, 2, 3; ``copies`` says how often a document is taken, those that
  are not taken go.

An empty table passes through. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontaminate, mixing, near, quality, secrets
from assayer.llm.text import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near_duplicates", unique),
    ("decontaminate", uncontaminated),
    ("secrets", without_secrets),
    ("mix", mixed),
]
#: Signatures and seeded draws have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
