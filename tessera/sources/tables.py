"""Typed loaders: the Parquet tables, literal relations, image folders and JSON configuration."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
IMAGE_PATTERN = r"\.(jpe?g|png|tiff?|psd|psb)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV or JSON files, JDBC tables or Kafka topics; text formats need a schema, as nothing is inferred."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", "true")).option("mode", options.get("mode", "FAILFAST"))
    reader = reader.schema(schema) if schema else reader
    return reader.load() if kind in ("jdbc", "kafka") else reader.load(path)


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def search_results(spark: SparkSession, n: int = 16) -> DataFrame:
    """The generated result relation: falling similarity, floor 54."""
    return spark.range(n).select(
        (F.col("id") + 1).alias("id"),
        F.format_string("asset_%03d.jpg", F.col("id") + 1).alias("name"),
        F.concat(F.lit("D:\\assets\\asset_"), (F.col("id") + 1).cast("string"), F.lit(".jpg")).alias("path"),
        F.greatest(F.lit(54), 97 - 3 * F.col("id")).cast("int").alias("similarity"),
    )


def activity_log(spark: SparkSession) -> DataFrame:
    """Six logged searches; result counts are fixed values, sum 122."""
    counts = [24, 12, 0, 47, 8, 31]
    rows = [(i + 1, f"query_{i + 1}.jpg", f"D:\\assets\\set_{i % 3}", n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "id long, image string, folder string, results int")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files below a folder, any letter case; `content` is read only where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(F.lower("path").rlike(IMAGE_PATTERN))


def config(spark: SparkSession, path: str, schema: str, default: dict) -> dict:
    """A one-object JSON configuration; the whole default where it is missing, empty or not JSON of this schema."""
    try:
        row = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
        return row.asDict() if row else dict(default)
    except PySparkException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "FAILED_READ_FILE.NO_HINT") or "MALFORMED_RECORD" in str(e):
            return dict(default)
        raise
    except Py4JJavaError as e:
        if "MALFORMED_RECORD" in str(e):
            return dict(default)
        raise
