"""A join of intervals that overlap, without an equal key, and what it adds up to for each row of one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BINS = 4096
RUN_BITS = 12


def _bins(start: Column, end: Column, width: int) -> Column:
    """The numbers of the bins that a half-open interval touches."""
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.ceil(end / width) - 1))


def _sound(rows: DataFrame, side: str) -> DataFrame:
    kept = rows.filter("start < end").withColumns({c: F.col(c).cast("long") for c in ("start", "end")})
    return kept.withColumnsRenamed({"start": f"{side}_start", "end": f"{side}_end"})


def overlaps(left: DataFrame, right: DataFrame, width: int | None = None, slices: int = 1) -> DataFrame:
    """All pairs whose half-open intervals [start, end) share a point.

    Both sides have whole numbers `start` and `end` and no other names in common; the result has all columns, those two as
    left_start, left_end, right_start, right_end. Time is cut into bins of `width`, both sides are copied to each bin
    that they touch, and bins are joined by equality. A pair is kept in the bin of the later of its two
    starts, which both touch, so it comes once. Where a bin is crowded, `slices` splits the left side of each
    bin and copies the right side to every slice.

    Without `width`, it is the mean length of both sides' intervals, so that an interval has two copies on average,
    but at least a MOST_BINS-th of the longest. Empty or null intervals overlap nothing; repeated rows pair each.
    """
    a, b = _sound(left, "left"), _sound(right, "right")
    if width is None:
        spans = a.select((F.col("left_end") - F.col("left_start")).alias("s")).unionAll(b.select(F.col("right_end") - F.col("right_start")))
        mean, longest = spans.agg(F.avg("s"), F.max("s")).first()
        width = max(1, round(mean or 1), -(-(longest or 1) // MOST_BINS))
    a = a.withColumn("_bin", F.explode(_bins(F.col("left_start"), F.col("left_end"), width)))
    b = b.withColumn("_bin", F.explode(_bins(F.col("right_start"), F.col("right_end"), width)))
    keys = ["_bin"]
    if slices > 1:
        a = a.withColumn("_slice", F.pmod(F.xxhash64(*[c for c in a.columns if c != "_bin"]), F.lit(slices)).cast("int"))
        b = b.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        keys.append("_slice")
    both = a.join(b, keys).filter("left_start < right_end and right_start < left_end")
    return both.filter(F.floor(F.greatest("left_start", "right_start") / width) == F.col("_bin")).drop(*keys)


def _sums_before(rows: DataFrame, names: list[str], low: int, high: int) -> DataFrame:
    """`rows`, which have distinct whole numbers `t` from low to high, with before_<name>: the sums of the rows of smaller t.

    Rows are added up in runs of 2 ** RUN_BITS numbers, and so are the runs' totals, so a window has no more rows than that.
    """
    run = F.shiftright(F.col("t") - low, RUN_BITS)
    w = Window.partitionBy(run).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({f"before_{c}": F.sum(c).over(w) - F.col(c) for c in names})
    last = (high - low) >> RUN_BITS
    if not last:
        return own
    totals = _sums_before(rows.groupBy(run.alias("t")).agg(*(F.sum(c).alias(c) for c in names)), names, 0, last)
    totals = totals.select(F.col("t").alias("_run"), *(F.col(f"before_{c}").alias(f"_{c}") for c in names))
    both = own.join(totals, run == F.col("_run"))
    return both.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in names}).select(own.columns)


def overlap_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of `left` that `overlaps` pairs with any of `right`, once each, with the number `n` of these pairs and the length `shared` in all of their common parts.

    Pairs are not made: right intervals that meet [start, end) are those that begin before its end, less those that end by its start; and
    what they share with it is what they cover up to its end, less what they cover up to its start. So the work grows with the rows of both sides, however many
    pairs there are. `left` has its interval as left_start, left_end in the result; its other names may be any but n and shared.
    """
    number = "decimal(38,0)"  # products of times and counts
    a, b, none = _sound(left, "left"), _sound(right, "right"), F.lit(0).cast(number)
    one = F.lit(1).cast(number)
    times = b.select(F.col("right_start").alias("t"), one.alias("begun"), none.alias("ended")).unionAll(b.select("right_end", none, one))
    asked = a.select(F.explode(F.array("left_start", "left_end")).alias("t"), none.alias("begun"), none.alias("ended"))
    times = times.unionAll(asked).groupBy("t").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    times = times.withColumn("moment", (F.col("t") * (F.col("begun") - F.col("ended"))).cast(number)).checkpoint()
    low, high = times.agg(F.min("t"), F.max("t")).first()
    times = _sums_before(times, ["begun", "ended", "moment"], low or 0, high or 0)
    covered = (F.col("t") * (F.col("before_begun") - F.col("before_ended"))).cast(number) - F.col("before_moment")
    starts = times.select(F.col("t").alias("left_start"), (F.col("before_ended") + F.col("ended")).alias("_gone"), covered.alias("_from"))
    ends = times.select(F.col("t").alias("left_end"), F.col("before_begun").alias("_come"), covered.alias("_to"))
    found = a.join(starts, "left_start").join(ends, "left_end").filter("_come > _gone")
    return found.select(*a.columns, (F.col("_come") - F.col("_gone")).cast("long").alias("n"), (F.col("_to") - F.col("_from")).cast("long").alias("shared"))
