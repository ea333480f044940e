"""A corpus in five steps: good documents, no toxic ones, one of each group of near copies, secrets out, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sorrel.llm.packing import pack_documents
from sorrel.llm.quality import keep_good
from sorrel.llm.secrets import redact
from sorrel.llm.simhash import one_of_each_group
from sorrel.llm.toxicity import keep_clean
from sorrel.llm.workspace import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    return keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees don't find toxic."""
    return keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints."""
    return one_of_each_group(spark, docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    ws, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
