"""A folder of files as a stream into an index of what is known of each file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import ivf
from tessera.sources.tables import IMAGE_PATTERN

FACTS = "path string, fingerprint string, size long, modified timestamp, batch long"
HEAD = 65536


def file_stream(spark: SparkSession, folder: str, pattern: str | None = IMAGE_PATTERN, files_a_batch: int = 10_000) -> DataFrame:
    """path, content and modified of the files below a folder that match a pattern in any letter case; `content` is read only where it is used."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    if pattern:
        files = files.filter(F.lower("path").rlike(pattern))
    return files.select("path", "content", F.col("modificationTime").alias("modified"))


def _index(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], FACTS)
        raise


def add_batch(files: DataFrame, batch: int, folder: str, head: int = HEAD) -> None:
    """Writes what is known of a batch's files to the index's folder of that batch.

    A batch that comes again, as after a failure between its write and the
    stream's commit, overwrites its own folder and nothing else. What counts as known are the batches
    before it, so it writes the same rows again. Files whose path, head, size and time are known already aren't written.
    """
    spark = files.sparkSession
    now = files.select("path", scalar.head_fingerprint(F.col("content"), head).alias("fingerprint"), F.octet_length("content").cast("long").alias("size"), "modified")
    known = latest(_index(spark, folder).filter(F.col("batch") < batch)).drop("batch")
    same = F.forall(F.array(*(now[c].eqNullSafe(known[c]) for c in ("path", "fingerprint", "size", "modified"))), lambda x: x)
    fresh = now.join(known, same & (now["path"] == known["path"]), "left_anti").dropDuplicates()
    fresh.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def latest(index: DataFrame) -> DataFrame:
    """The newest row of each path."""
    newest = Window.partitionBy("path").orderBy(F.desc("batch"), F.desc("modified"), "fingerprint")
    return index.withColumn("place", F.row_number().over(newest)).filter("place = 1").drop("place")


def follow(files: DataFrame, folder: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, head: int = HEAD) -> None:
    """Indexes all files that the stream has now, in batches; the next call goes on from there.

    `then` gets each batch and its number afterwards, to embed and store vectors for instance; it too may see a batch again.
    """

    def write(batch_files: DataFrame, batch: int) -> None:
        add_batch(batch_files, batch, folder, head)
        if then:
            then(batch_files, batch)

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def vectors_into(index: str, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For `follow`: puts the vectors of each batch's files into an inverted-file index, under the batch's name, so that a batch that comes again adds nothing.

    `embed` makes vec_id, embedding and any metadata of path, content and modified.
    """

    def store(files: DataFrame, batch: int) -> None:
        ivf.add(embed(files), index, f"batch-{batch}")

    return store
