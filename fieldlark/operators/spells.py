"""Table functions for SQL: spells of days, one partition of a table at a time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SPELLS = "key bigint, first date, last date, days int, worst double, total double, recommendation string"


class Spells:
    """Runs of consecutive days at or over a limit, and what to do about each.

    Called as ``SELECT * FROM spells(limit, TABLE(..) PARTITION BY key ORDER BY date)``
    over rows (key, date, value). A missing value, a missing day or one below the
    limit ends a run; of two rows of a day the larger value counts. It holds one
    run at a time, so a partition may have any number of days.
    """

    def __init__(self):
        self.run = None

    def _told(self):
        key, first, last, worst, total, _ = self.run
        days = (last - first).days + 1
        return key, first, last, days, worst, total, "irrigate now" if days >= 3 else "irrigate soon" if days == 2 else "watch"

    def eval(self, limit: float, row):
        key, day, value = row[0], row[1], row[2]
        if self.run is not None and day == self.run[2]:
            if value is not None and value > self.run[5]:  # the day again
                self.run[3], self.run[4], self.run[5] = max(self.run[3], value), self.run[4] + value - self.run[5], value
            return
        over = value is not None and value >= limit
        if self.run is not None and not (over and day == self.run[2] + timedelta(days=1)):
            yield self._told()
            self.run = None
        if over and self.run is None:
            self.run = [key, day, day, value, value, value]
        elif over:
            self.run[2], self.run[3], self.run[4], self.run[5] = day, max(self.run[3], value), self.run[4] + value, value

    def terminate(self):
        if self.run is not None:
            yield self._told()


def register(spark: SparkSession) -> SparkSession:
    """Let the session's SQL call ``spells``."""
    spark.udtf.register("spells", udtf(Spells, returnType=SPELLS))
    return spark
