"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and its decisions take effect; all but
the last return the columns of documents. `run` writes each stage's rows as
Parquet to the shared folder and reads them again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, packing, pii, quality
from tessera.llm.tokens import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; without labelled rows nothing can be judged, and all stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.add_score(docs, model, name).filter(F.col(name) >= quality.THRESHOLD).drop(name)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that of the smallest id; rows of one id with other texts are judged apart, those without an id come last."""
    return jaccard.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no test item, whatever their ids."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in its sequence."""
    return packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The stages' methods have no SQL; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
