"""Streaming queries over the event table, each against the SQL of its batch form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query, shown
from weftline.sources.tables import USAGE
from weftline.streaming import events as S


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one serves local sessions only, whose executor is the driver."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return f"{sc.getCheckpointDir()}/streams"


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in one batch: its files are in no order of time, so that in several batches older events would be late."""
    return S.source(spark, f"{sf_dir}/events.parque[t]", None)  # a pattern, for the table may be one file


@query("t01_t12_stream_once", f"""with {USAGE} select org_id, kind, strftime("at", '%Y-%m-%d') as day from usage group by all""")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under an idempotency key (organisation, kind, day) pass once."""
    keyed = arriving(spark, sf_dir).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return S.drained(spark, S.once(keyed, ["org_id", "kind", "day"], "40 days"), folder(spark)).select("org_id", "kind", "day")


@query("t16_t17_stream_metered", f"""with {USAGE} select org_id, kind, strftime("at", '%Y-%m') as period, count(*) as n, sum(amount)::double as amount from usage group by all""")
def stream_metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of a stream, summed to months: the last state of each window counts."""
    last = lambda df: df.groupBy("start", "org_id", "kind").agg(F.max_by(F.struct("n", "amount"), "n").alias("x")).select("start", "org_id", "kind", "x.*")
    days = S.drained(spark, S.metered(arriving(spark, sf_dir)), folder(spark), "update", last)
    return days.groupBy("org_id", "kind", F.date_format("start", "yyyy-MM").alias("period")).agg(F.sum("n").alias("n"), shown(F.sum("amount")).alias("amount"))


@query("t03_t15_stream_failures", f"""
with {USAGE}, runs as (select *, count(*) filter (kind <> 'error') over (partition by org_id order by "at", id) as island from usage),
lengths as (select org_id, island, count(*) filter (kind = 'error') as n from runs group by all)
select org_id, max(n) as longest, max(n) >= 5 as disabled from lengths group by org_id""")
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of failures, kept as state."""
    last = lambda df: df.groupBy("org_id").agg(F.max("longest").alias("longest"), F.bool_or("disabled").alias("disabled"))
    return S.drained(spark, S.failure_runs(arriving(spark, sf_dir)), folder(spark), "update", last)


@query("t02_t07_t11_stream_holds", f"""
with {USAGE}, held as (select id, org_id, "at", lead("at") over (partition by org_id order by "at", id) as next from usage)
select id, case when next > "at" + interval 10 minute then 'expired' else 'released' end as outcome from held where next is not null""")
def stream_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds that end with the next event or by a timer; the last hold of each organisation is still open."""
    found = S.drained(spark, S.holds(arriving(spark, sf_dir), delay="1 day"), folder(spark))
    ends = arriving_batch(spark, sf_dir).groupBy("org_id").agg(F.max_by("id", F.struct("at", "id")).alias("id"))
    return found.join(ends, ["org_id", "id"], "left_anti").select("id", "outcome")


def arriving_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.sources.tables import usage

    return usage(spark, sf_dir)


@query("t05_t14_stream_sessions", f"""
with {USAGE}, gaps as (select *, case when "at" > lag("at") over (partition by org_id order by "at", id) + interval 10 minute or lag("at") over (partition by org_id order by "at", id) is null then 1 else 0 end as starts from usage),
numbered as (select *, sum(starts) over (partition by org_id order by "at", id) as s from gaps)
select org_id, strftime(min("at"), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from numbered group by org_id, s having max("at") < (select max("at") from usage) - interval 75 minute""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed, with a margin."""
    found = S.drained(spark, S.sessions(arriving(spark, sf_dir)), folder(spark))
    newest = arriving_batch(spark, sf_dir).agg(F.max("at").cast("timestamp").alias("newest"))  # one row
    closed = found.crossJoin(F.broadcast(newest)).where(F.col("end") - F.expr("interval 10 minutes") < F.col("newest") - F.expr("interval 75 minutes"))
    return closed.select("org_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("t04_t06_stream_routed", "select event_type as kind, count(*) as n from events where event_type in ('click', 'error') group by event_type")
def stream_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream written to a table a kind, batch by batch."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    sinks = {kind: f"{path}/{kind}" for kind in ("click", "error")}
    S.routed(arriving(spark, sf_dir), sinks, f"{path}/state").awaitTermination()
    read = [spark.read.parquet(where).select(F.lit(kind).alias("kind")) for kind, where in sinks.items()]
    return read[0].union(read[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


PIECES = 6


@query("t02_t07_t08_t10_stream_timers", f"""
with {USAGE}, held as (select id, org_id, "at", lead("at") over (partition by org_id order by "at", id) as next from usage),
told as (select id, case when next <= "at" + interval 10 minute then 'released' else 'expired' end as outcome, case when next <= "at" + interval 10 minute then next else "at" + interval 10 minute end as ends from held)
select id, outcome, strftime(ends, '%Y-%m-%d %H:%M:%S.%g') as ends from told where ends + interval 1 millisecond <= (select max("at") - interval 1 hour from usage)""")
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they come, in batches by time: holds that the next event releases or a timer ends, as far as the watermark has come."""
    from weftline.sources.tables import usage
    from weftline.streaming import timers

    u = usage(spark, sf_dir).select("id", "org_id", F.col("at").cast("timestamp").alias("at"))
    first, last = u.agg(F.min("at").cast("double"), F.max("at").cast("double")).first()
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    part = F.least(F.floor((F.col("at").cast("double") - (first or 0)) / max(1.0, ((last or 0) - (first or 0)) / PIECES)), F.lit(PIECES - 1))
    before = {k: spark.conf.get(k, None) for k in timers.PROVIDER}
    for k, v in timers.PROVIDER.items():
        spark.conf.set(k, v)
    try:
        for i in range(PIECES):  # each later than those before; its files are in no order, so they come in one batch
            u.where(part == i).write.mode("append").parquet(f"{path}/in")
            source = spark.readStream.schema(u.schema).parquet(f"{path}/in")
            found = S.drained(spark, timers.holds(source, 10, "1 hour"), path, name="run")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return found.select("id", "outcome", F.date_format("ends", "yyyy-MM-dd HH:mm:ss.SSS").alias("ends"))
