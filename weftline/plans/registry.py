"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name that starts with the ids of the operators it shows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f

    return keep


def shown(amount: Column | str) -> Column:
    """A decimal as a double, at the edge only: sums and products of money stay decimal."""
    return (F.col(amount) if isinstance(amount, str) else amount).cast("double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and jobs by month, months without jobs included."""
    return QUERIES["a04_a05_revenue_by_month"](spark, sf_dir)
