"""Table functions for SQL, which take a table in partitions and in order."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="user_id long, first_event long, length long, rise double")
class RisingRun:
    """The longest run of ever larger values of one user, of equal ones the first; needs rows (user_id, event_id, value) in order of time.

    A null value ends a run and is in none. Holds one run at a time, however many rows a user has.
    """

    def __init__(self):
        self.user = None
        self.run = self.best = None

    def eval(self, row: Row):
        self.user, value = row["user_id"], row["value"]
        if value is None:
            self.run = None
            return
        if self.run and value > self.run[3]:
            first, length, low, _ = self.run
            self.run = first, length + 1, low, value
        else:
            self.run = row["event_id"], 1, value, value
        if self.best is None or self.run[1] > self.best[1]:
            self.best = self.run

    def terminate(self):
        if self.best:
            first, length, low, high = self.best
            yield self.user, first, length, high - low


def register(spark: SparkSession) -> None:
    """Makes `rising_run` known to SQL: SELECT * FROM rising_run(TABLE(events) PARTITION BY user_id ORDER BY (ts, event_id))."""
    spark.udtf.register("rising_run", RisingRun)
