"""Overlap counts by sorting within a key, without range joins; as-of joins are in ``prefix``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


POINTS = 1_000_000  # that a task sorts, about, where no key has more


def _counted(df: DataFrame, keys: Sequence[str], ask: tuple[str, Column], add: tuple[str, Column], name: str, tasks: int) -> DataFrame:
    """``df`` with how many rows of the key add before the row asks, each at a column's place, there in order of the numbers beside it."""
    point = lambda at, row: F.struct(F.col(at[0]).alias("_at"), at[1].alias("_kind"), row.alias("_row"))
    points = F.array(point(ask, F.struct(*df.columns)), point(add, F.lit(None).cast(df.schema)))
    every = df.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.*").repartition(tasks, *keys)
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(name, F.count_if(F.col("_row").isNull()).over(w)).where(F.col("_row").isNotNull()).select("_row.*", name)


def overlap_counts(df: DataFrame, keys: Sequence[str], first: str, last: str, name: str) -> DataFrame:
    """How many other half-open spans [first, last) of the key overlap each span: those that start before its end less
    those that end by its start. No pair is made: rows are sorted twice, once among starts and once among ends, in as many tasks
    as there are rows for, and only the row that asks is carried. An empty span overlaps the spans that it lies strictly
    inside, and no other empty one. ``df`` is gone through for its number of rows."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.count() // POINTS)
    started = _counted(df, keys, (last, F.lit(0)), (first, F.lit(1)), "_starts", tasks)
    # at one place: ends, empty spans ask, empty spans end, other spans ask
    empty = F.col(first) == F.col(last)
    ended = _counted(started, keys, (first, F.when(empty, 1).otherwise(3)), (last, F.when(empty, 2).otherwise(0)), "_ends", tasks)
    own = F.when(F.col(first) < F.col(last), 1).when(empty, 0).otherwise(-1)
    return ended.select(*df.columns, (F.col("_starts") - F.col("_ends") - own).alias(name))
