"""The training-data pipeline: stages over ``documents``, each a call of one operator.

Defined cases, of every stage: rows with a null, empty or wordless text stay
(the mix takes a share of its sources' rows of every size, 0 too); rows without an id are never
duplicates of others and stay; rows of one id are judged one by one by their texts, but count as
one document among near duplicates; all columns of the input are returned, whatever
their names, and the mix replaces those that are named like its own; an empty table
gives no rows.  Ties are broken by the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate as decontamination
from cohortlens.llm import mixing, secret_scan, set_join
from cohortlens.llm import toxicity as toxic
from cohortlens.llm.shared import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; the rest stays as it is."""
    return toxic.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    return set_join.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; a document that is mostly such passages goes."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's target, copies and words taken
    (equally named columns of ``docs`` are replaced)."""
    rows = mixing.mix(docs.drop("size", "taken")).where("copies > 0")
    return rows.withColumnsRenamed({"mx_size": "size"}).withColumn("taken", F.col("copies") * F.col("size"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mix_sources", mix_sources),
]

#: A fitted classifier decides in the first stage, which SQL can't express; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
