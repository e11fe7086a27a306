"""A corpus pipeline of operators of ``textloom.llm``: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, jaccard_tree, mixing, sharding, toxicity
from textloom.llm.shared import Scratch, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model, 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more: that of the smallest id."""
    return jaccard_tree.one_of_each(docs, n_words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, whether they have an id or not."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in global random order."""
    rate, copy = unused(docs, "mix_rate", "mix_copy")
    return mixing.mix_sources(docs, rate_col=rate, copy_col=copy).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, 0 to 7."""
    return docs.withColumn("shard", sharding.placed(sharding.even_tree(8), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("int"))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]

#: Classifiers and retrieval are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages, each written before the next reads it and deleted when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(written.path(str(k)))
        docs = spark.read.parquet(written.path(str(k)))
        if k:
            written.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
