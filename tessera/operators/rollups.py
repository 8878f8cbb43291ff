"""Counts that merge: distinct counts and quantiles from what was stored for each day, without the rows.

Sketches are approximate within a stated bound; bitmaps are exact, for ids that are small whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_CONFIG = 12
#: Relative standard errors of one sketch: 1.04 / sqrt(2**LG_CONFIG) for HLL, 1 / sqrt(2**LG_CONFIG) for theta; a bound is three of these.
HLL_BOUND = 3 * 1.04 / 2 ** (LG_CONFIG / 2)
THETA_BOUND = 3 / 2 ** (LG_CONFIG / 2)
#: Rank error of a KLL sketch with k = 200, as a share of all rows, at 99 percent.
KLL_K, KLL_BOUND = 200, 0.0133


def sketches(rows: DataFrame, keys: list[str], of: str, value: str) -> DataFrame:
    """For each key: n, an HLL and a theta sketch of the distinct `of`, and a KLL sketch of `value`. Nulls are in none of the sketches."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(of, LG_CONFIG).alias("hll"), F.theta_sketch_agg(of, LG_CONFIG).alias("theta"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("kll")
    )


def merged(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The stored sketches, merged over all but `keys`."""
    all_ = stored.groupBy(*keys) if keys else stored.groupBy()
    return all_.agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", LG_CONFIG).alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def distinct(hll: str = "hll") -> Column:
    return F.hll_sketch_estimate(hll)


def in_both(theta: Column, other: Column) -> Column:
    """Distinct values that two theta sketches share."""
    return F.theta_sketch_estimate(F.theta_intersection(theta, other))


def quantile(share: float, kll: str = "kll") -> Column:
    return F.kll_sketch_get_quantile_double(kll, F.lit(share))


def bitmaps(rows: DataFrame, keys: list[str], of: str) -> DataFrame:
    """For each key and bucket of 32,768 ids, a bitmap of the ids that occur, which must be whole numbers; null ids are in none."""
    bucket = F.bitmap_bucket_number(of).alias("bucket")
    return rows.filter(F.col(of).isNotNull()).groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(of)).alias("bits"))


def distinct_ids(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The exact number of distinct ids for each of `keys`: bitmaps of a bucket are merged by OR, then counted, then added over buckets."""
    one = stored.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return (one.groupBy(*keys) if keys else one.groupBy()).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_ids"))
