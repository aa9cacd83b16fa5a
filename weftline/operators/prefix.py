"""Prefix scans: running sums and values carried along in the order of a key, where one key may hold most of the rows.

A window over a key is one task's work. Here a key with more than a thousandth of the rows is cut into ranges of its order,
about a thousand ranges over all such keys; each range is scanned in its own task, and what the ranges before it add up to, or
the last value that they hold, is carried in. The cuts are quantiles of the order; the driver holds them only: fewer than a
thousand keys and some two thousand numbers, whatever the rows. Rows that tie in the first column of the order stay in one
range, so a key whose rows all tie there is not cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1000
LEAST = 100_000  # rows of a range, about


def _number(df: DataFrame, at: str) -> Column:
    """The order as a number that rises with it; null comes first."""
    kind = df.schema[at].dataType.simpleString()
    c = F.col(at)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return c.cast("timestamp").cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return c.cast("double")
    raise ValueError(f"{at} is no number and no time, so its order can't be cut")


def spread(df: DataFrame, keys: Sequence[str], at: str, least: int = LEAST, name: str = "_range") -> DataFrame:
    """``df`` with the number of each row's range within its key; 0 for keys that are not cut. ``df`` is gone through for its
    counts and its cuts, so it should be a table or cheap to make."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = {tuple(r[k] for k in keys): min(-(-RANGES * r["n"] // total), r["n"] // least) for r in counts.where((F.col("n") * RANGES > total) & (F.col("n") >= 2 * least)).collect()}
    if not parts:
        return df.withColumn(name, F.lit(0))
    spark, value = df.sparkSession, _number(df, at)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in keys]
    hot = spark.createDataFrame(list(parts), kinds)
    # one pass over the rows of hot keys: a summary of each key's order, from which the cuts are read
    shares = [i / RANGES for i in range(1, RANGES)]
    summary = df.alias("l").join(F.broadcast(hot.alias("h")), same, "left_semi").groupBy(*keys).agg(F.percentile_approx(value, shares, 20 * RANGES).alias("q"))
    rows = []
    for r in summary.collect():
        key = tuple(r[k] for k in keys)
        m = parts[key]
        rows.append((*key, sorted({r["q"][round(i * RANGES / m) - 1] for i in range(1, m)}) if r["q"] else []))
    cuts = spark.createDataFrame(rows, f"{kinds}, _cuts array<double>")
    told = df.alias("l").join(F.broadcast(cuts.alias("h")), same, "left").select("l.*", "h._cuts").withColumn("_place", value)
    behind = F.size(F.filter("_cuts", lambda c: c < F.col("_place")))
    return told.withColumn(name, F.when(F.col("_cuts").isNull() | F.col("_place").isNull(), 0).otherwise(behind)).drop("_cuts", "_place")


def _before(totals: DataFrame, keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, least: int = LEAST) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key up to each row, in order; that row included."""
    cut = spread(df, keys, order[0], least)
    inside = F.sum(value).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = cut.groupBy(*keys, "_range").agg(F.sum(value).alias("_t"))
    carried = totals.withColumn("_carry", F.sum("_t").over(_before(totals, keys))).where("_range > 0").drop("_t")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_range")]
    # only ranges behind a first one have something to carry: some thousand rows
    both = cut.withColumn("_inside", inside).alias("l").join(F.broadcast(carried.alias("c")), same, "left")
    total = F.when(F.col("_inside").isNotNull() | F.col("_carry").isNotNull(), F.coalesce("_inside", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return both.select(*(F.col(f"l.`{c}`") for c in df.columns), total.alias(name))


def as_of(rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], least: int = LEAST) -> DataFrame:
    """``rows`` with the values of the last version at or before ``at`` in their key; rows before the first one go. Of versions
    at one place the largest counts."""
    told = versions.groupBy(*keys, at).agg(F.max(F.struct(*values)).alias("_v"))
    stacked = told.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    cut = spread(stacked, keys, at, least)
    w = Window.partitionBy(*keys, "_range").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.where("_side = 0").groupBy(*keys, "_range").agg(F.max_by("_v", at).alias("_l"))
    # every range asks for the last version before it, whether or not it has one itself
    ranges = cut.select(*keys, "_range").distinct()
    named = [F.col(f"r.{k}").eqNullSafe(F.col(f"v.{k}")) for k in (*keys, "_range")]
    each = ranges.alias("r").join(last.alias("v"), named, "left").select("r.*", "v._l")
    carried = each.withColumn("_carry", F.last("_l", ignorenulls=True).over(_before(each, keys))).where("_range > 0").drop("_l")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_range")]
    both = cut.withColumn("_inside", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").alias("l").join(F.broadcast(carried.alias("c")), same, "left")
    found = both.withColumn("_last", F.coalesce("_inside", "_carry")).where("_last is not null")
    return found.select(*(F.col(f"l.`{c}`") for c in rows.columns), *(F.col("_last")[v].alias(v) for v in values))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, least: int = LEAST) -> DataFrame:
    """``df`` with ``value`` of the row before each row in its key and order; null for the first one."""
    cut = spread(df, keys, order[0], least)
    inside = F.lag(value).over(Window.partitionBy(*keys, "_range").orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) == 1
    ends = cut.groupBy(*keys, "_range").agg(F.max_by(value, F.struct(*order)).alias("_e"))
    carried = ends.withColumn("_carry", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_range"))).where("_range > 0").drop("_e")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_range")]
    both = cut.withColumn("_inside", inside).withColumn("_first", first).alias("l").join(F.broadcast(carried.alias("c")), same, "left")
    return both.select(*(F.col(f"l.`{c}`") for c in df.columns), F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_inside")).alias(name))
