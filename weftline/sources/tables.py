"""Views of the driver's tables in the shapes that the operators expect, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation jobs: one an order."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    state = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "running").otherwise("review")
    days = F.substring("o_orderpriority", 1, 1).cast("int") * 10
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("n_regionkey").alias("org_id"),
        F.col("o_custkey").alias("account_id"),
        state.alias("state"),
        F.col("o_orderdate").alias("created_at"),
        F.date_add(F.col("o_orderdate").cast("date"), days).alias("due_on"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("revenue"),
        F.col("c_mktsegment").alias("content_type"),
        F.col("n_name").alias("target_lang"),
    )


JOBS = """jobs as (
  select o_orderkey as id, n_regionkey as org_id, o_custkey as account_id,
    case o_orderstatus when 'F' then 'delivered' when 'O' then 'running' else 'review' end as state,
    o_orderdate as created_at, cast(o_orderdate as date) + cast(substr(o_orderpriority, 1, 1) as integer) * 10 as due_on,
    cast(o_totalprice as decimal(12,2)) as revenue, c_mktsegment as content_type, n_name as target_lang
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of jobs: one a line item. ``place`` makes every order total."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("seq"),
        place.alias("place"),
        F.col("l_quantity").cast("int").alias("words"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("cost"),
        F.when(F.col("l_returnflag") == "A", "auto_approve").when(F.col("l_returnflag") == "R", "review").alias("decision"),
        (F.col("l_linestatus") == "F").alias("done"),
        F.col("l_suppkey").alias("vendor_id"),
        F.col("l_partkey").alias("part_id"),
        (F.lit(50) + F.pmod(F.col("l_partkey") * 37, F.lit(100)) * 0.5).alias("score"),
        F.col("l_shipdate").alias("delivered_at"),
        F.col("l_discount").cast("decimal(4,2)").alias("discount"),
    )


SEGMENTS = """segments as (
  select l_orderkey as job_id, l_linenumber as seq, l_partkey as part_id, l_suppkey as vendor_id, cast(l_quantity as integer) as words,
    cast(l_extendedprice as decimal(12,2)) as cost, case l_returnflag when 'A' then 'auto_approve' when 'R' then 'review' end as decision,
    l_linestatus = 'F' as done, 50 + ((l_partkey * 37) % 100) * 0.5 as score, l_shipdate as delivered_at,
    cast(l_discount as decimal(4,2)) as discount,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount) as n
  from lineitem)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records, ledger movements and queue items: one an event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("org_id"),
        F.col("event_type").alias("kind"),
        F.col("value").cast("decimal(14,2)").alias("amount"),
        F.col("ts").alias("at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


USAGE = """usage as (
  select event_id as id, user_id as org_id, event_type as kind, cast(value as decimal(14,2)) as amount, ts as "at",
    cast(json_extract_string(props, '$.k') as integer) as k
  from events)"""
