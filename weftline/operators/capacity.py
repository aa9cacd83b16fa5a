"""Work spread over days, and the risk that it isn't done in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(spans: DataFrame, keys: Sequence[str], first: str, last: str, words: str) -> DataFrame:
    """(keys, day, words): the words of each span in equal whole parts over its working days, first and last included.

    A span gives a row a day, and the sums are combined before the shuffle.
    """
    days = F.filter(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day")), lambda d: F.weekday(d) < 5)
    each = spans.select(*keys, words, days.alias("_days")).where(F.size("_days") > 0)
    parts = each.select(*keys, F.floor(F.col(words) / F.size("_days")).alias("words"), F.explode("_days").alias("day"))
    return parts.groupBy(*keys, "day").agg(F.sum("words").alias("words"))


def risk(jobs: DataFrame, today: Column, a_day: float = 4.0) -> DataFrame:
    """``jobs`` (state, due_on, open, total) with the days left, one at least, and the risk: none, low, medium, high, late."""
    left = F.greatest(F.lit(1), F.datediff("due_on", today))
    level = F.when((F.col("state") == "delivered") | (F.col("open") == 0), "none").when(F.col("due_on") < today, "late").when(F.col("open") / left > a_day, "high").when(F.col("open") * 2 > F.col("total"), "medium").otherwise("low")
    return jobs.withColumn("days", left).withColumn("risk", level)
