"""The queries of the training-data operators, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bestfit, decontaminate, divergence, jaccard, licenses, neighbours, oracles, packing, pii, quality, ranking, revisits, substring, tokenfile
from tessera.llm.tokens import vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.add_score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(revisits.captures(_table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    page = F.floor(F.col("record_id") / 3).cast("long")
    return out.select("record_id", page.alias("page_id"), "url_key", "refers_to", "status", headers.alias("headers"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_substring": op5_substring,
    "op6_revisits": op6_revisits,
    "op7_neighbours": op7_neighbours,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_jaccard": op10_jaccard,
    "op11_bestfit": op11_bestfit,
    "op12_ranking": op12_ranking,
    "op13_divergence": op13_divergence,
}

SQL: dict[str, str] = oracles.SQL
