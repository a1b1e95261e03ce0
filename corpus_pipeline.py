"""A training corpus from ``documents``: five stages, each over all the one before kept.

1. quality classifier: documents it rejects go;
2. n-gram Jaccard join: one document of each near-duplicate group stays;
3. benchmark decontamination: documents with a leaked item go;
4. source mixing: documents beyond their source's budget go;
5. token file: the rest is encoded, written and read back.

Each function takes (spark, docs, sf_dir). Every result is written as Parquet in the
shared folder and read again as the next stage's documents. All stages but the
last return the columns of ``documents``; the last returns one row per encoded document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm.decontamination import keep_clean
from wardline.llm.deploy import ship_package, written
from wardline.llm.jaccard_join import keep_one_per_component
from wardline.llm.mixing import keep_mix
from wardline.llm.quality_classifier import keep_good
from wardline.llm.token_file import default_tokenizer, encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return encode_documents(docs, default_tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

# The classifier's scores cannot be expressed in SQL; tests hold every stage against
# a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
