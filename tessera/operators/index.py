"""A stored index of vectors and metadata, and the log of searches on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import search


def store(vectors: DataFrame, folder: str, width: int) -> DataFrame:
    """Appends vec_id, embedding, folder and other metadata in order of `folder`; returns the rows of another width, which aren't stored.

    Files hold ranges of folders, whose statistics let a search in one folder pass over the others; a large folder has several files.
    """
    good = (F.size("embedding") == width) & F.col("embedding").isNotNull()
    ranged = vectors.filter(good).repartitionByRange("folder", "vec_id").sortWithinPartitions("folder", "vec_id")
    ranged.write.mode("append").parquet(folder)
    return vectors.filter(~F.coalesce(good, F.lit(False)))


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def find(index: DataFrame, query: DataFrame, max_results: int, folder: str | None = None) -> DataFrame:
    """The nearest rows to the only row of `query`; within a folder and what is below it, if one is named (a filter that is pushed to the scan)."""
    if folder is not None:
        inside = folder.rstrip("\\/")
        index = index.filter((F.col("folder") == inside) | F.col("folder").startswith(inside + "\\") | F.col("folder").startswith(inside + "/"))
    return search.top_k(index, query, max_results)


def log_entries(found: DataFrame, threshold: int = 0) -> DataFrame:
    """Per query the number of results of at least `threshold` percent, and whether there is none."""
    n = F.count_if(F.col("percent") >= threshold)
    return found.groupBy("query_id").agg(n.alias("results")).withColumn("empty", F.col("results") == 0)


def append_log(entries: DataFrame, folder: str) -> None:
    """Adds rows (query_id, results, empty, ts) to the log, which is kept by day."""
    entries.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)


def recent(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return spark.read.parquet(folder).drop("day").orderBy(F.desc("ts"), "query_id").limit(n)


def searches_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """day, searches, empty: how many searches there were and how many found nothing."""
    return spark.read.parquet(folder).groupBy("day").agg(F.count("*").alias("searches"), F.count_if("empty").alias("empty"))


def prune_log(spark: SparkSession, folder: str, keep_days: int, today: str) -> list[str]:
    """Deletes the days of the log that are `keep_days` or more before `today`; returns these. Rows without a time stay."""
    days = [r[0] for r in spark.read.parquet(folder).select("day").distinct().filter(F.date_diff(F.lit(today).cast("date"), "day") >= keep_days).collect()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    for day in days:  # a row a day
        at = path(f"{folder}/day={day}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return sorted(str(d) for d in days)


def changes(files: DataFrame, index: DataFrame, head: int = 65536) -> DataFrame:
    """path, status: new, changed (other head, length or time), same or gone, of files (path, content, modified) against an index of the same columns' facts."""
    now = facts(files, head).alias("a")
    both = now.join(index.alias("b"), F.col("a.path") == F.col("b.path"), "full")
    equal = F.forall(F.array(*[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("fingerprint", "size", "modified")]), lambda x: x)
    status = F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "gone").when(equal, "same").otherwise("changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status"))


def facts(files: DataFrame, head: int = 65536) -> DataFrame:
    """What an index keeps of a file: path, hash of its head, length and time of change."""
    return files.select("path", scalar.head_fingerprint(F.col("content"), head).alias("fingerprint"), F.octet_length("content").cast("long").alias("size"), "modified")
