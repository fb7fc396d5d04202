"""A training corpus from documents: language, near-duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again for the next one. All but the last
return the columns of documents; a column that a stage does not know is carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import decontaminate, language, mixing, sharding, simhash
from daybook.llm.batches import columns_of, fresh
from daybook.runtime import scratch

#: Least score of a predicted language. Far texts score near 0.5 whatever they hold; `language.KnownTrigrams` rejects those.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents written in one of the learned languages. Without labels nothing is known, and nothing is rejected."""
    model = language.fit(docs)
    if not model.labels:
        return docs
    judge, name = language.judge(spark, model), fresh(docs.columns, "_language")
    rows = docs.withColumn(name, judge(F.col("text")))
    kept = rows.where(F.col(f"{name}.learned") & (F.col(f"{name}.score") >= LEAST_SCORE))
    return kept.select(*columns_of(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the lowest id of each component of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words stand in benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources' words come near their targets."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard out of 16."""
    return sharding.sharded(docs)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: Language identification has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
