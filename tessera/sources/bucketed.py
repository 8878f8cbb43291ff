"""Catalog tables in buckets of their key, so that joins and groups on it need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket, about: a task sorts a bucket, in memory if it can.
ROWS = 500_000


def buckets_for(*tables: DataFrame, rows: int = ROWS) -> int:
    """How many buckets tables that are to be joined need, so that those of the largest have `rows` rows on average."""
    return max(1, *(-(-t.count() // rows) for t in tables))


def save(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """Writes a catalog table whose files hold one bucket of `keys` each, in their order, and reads it.

    Rows are dealt by the same hash as buckets are, so there is one file a bucket, not one for each
    bucket and task. With `path` its files are there, else in the warehouse. A key with
    very many rows makes a large bucket: bucket by more columns then.
    """
    writer = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return rows.sparkSession.table(name)


def tables(spark: SparkSession) -> list[str]:
    """Names of the tables in the current catalog database that aren't views of the session."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)
