"""Hash trees over fixed blocks of files: equal roots mean equal content, and unequal ones lead to the blocks that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 65536


def blocks(content: Column, size: int = BLOCK) -> Column:
    """The hash of each block of `size` bytes, the last one shorter; of empty content, the hash of nothing. Null for null."""
    n = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substring(content, i * size + 1, F.lit(size)), 256))


def levels(leaves: Column) -> Column:
    """All levels, the leaves first: a node is the hash of its two children's hex digits, a last one without a pair goes up as it is."""

    def above(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1)
        return F.transform(pairs, lambda i: F.when(F.get(level, 2 * i + 1).isNull(), F.get(level, 2 * i)).otherwise(F.sha2(F.concat(F.get(level, 2 * i), F.get(level, 2 * i + 1)), 256)))

    height = F.ceil(F.log2(F.size(leaves).cast("double"))).cast("int")
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), lambda all_, _: F.concat(all_, F.array(above(F.element_at(all_, -1)))))


def tree(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """path, size, root, leaves of files (path, content)."""
    leaves = files.select("path", F.octet_length("content").cast("long").alias("size"), blocks(F.col("content"), size).alias("leaves"))
    return leaves.withColumn("root", F.element_at(F.element_at(levels(F.col("leaves")), -1), 1)).select("path", "size", "root", "leaves")


def changed_blocks(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, block: the numbers of the blocks that differ, came or went, between two tables of `tree`, for files in both. Only the leaves of unequal roots are compared."""
    both = now.alias("a").join(before.alias("b"), F.col("a.path") == F.col("b.path")).filter(~F.col("a.root").eqNullSafe(F.col("b.root")))
    n = F.greatest(F.size("a.leaves"), F.size("b.leaves"))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get("a.leaves", i).eqNullSafe(F.get("b.leaves", i)))
    return both.select(F.col("a.path").alias("path"), F.explode(F.transform(differ, lambda i: i.cast("long"))).alias("block"))
