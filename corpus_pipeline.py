"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each
result as Parquet into the shared folder and reads it for the next.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, ngram_join, packing, secret_forest, toxicity
from lodeseek.llm.storage import written
from lodeseek.session import reachable


def _relieved(stage):
    """The stage, begun with a driver that has given back what the one before left: hundreds of small
    jobs, their plans and broadcasts fill its heap up to the limit otherwise."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.sparkContext._jvm.System.gc()
        return stage(spark, docs, sf_dir)

    return run_stage


@_relieved
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from their labels."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_relieved
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that 5-word shingles link at 0.8 or more.  Rows of one doc_id
    and text are one document; unlike texts of one doc_id are documents of their own.  Rows without a
    doc_id belong to no group and stay."""
    key = "key"
    while key in docs.columns:
        key += "_"
    groups = written(ngram_join.similar_components(docs), "groups")
    first = groups.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("key").alias(key)).select("doc_id", key).distinct()
    kept = docs.withColumn(key, F.xxhash64("text")).join(first, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


@_relieved
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_relieved
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secret_forest.redact(docs)


@_relieved
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.placed(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express learned models and tokens; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
