"""Dashboards, metering, ledgers, invoices and scorecards: aggregates over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators import prefix
from weftline.operators import relational as ops
from weftline.plans.registry import query, shown
from weftline.sources.tables import JOBS, SEGMENTS, USAGE, jobs, segments, table, usage

PERIODS = "created_at >= timestamp '1998-01-01' and created_at < timestamp '1999-01-01'"
BEFORE = "created_at >= timestamp '1997-01-01' and created_at < timestamp '1998-01-01'"


@query("a04_a05_revenue_by_month", """
with months as (select strftime(m, '%Y-%m') as month from generate_series(timestamp '1994-06-01', timestamp '2001-12-01', interval 1 month) as t(m)),
by_month as (select strftime(o_orderdate, '%Y-%m') as month, sum(o_totalprice::decimal(12,2)) as revenue, count(*) as n from orders group by 1)
select month, coalesce(revenue, 0)::double as revenue, coalesce(n, 0) as n_jobs from months left join by_month using (month)""")
def revenue_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and jobs by month over a fixed range; months without jobs show zeros."""
    wanted = {"sum": F.sum(F.col("o_totalprice").cast("decimal(12,2)")), "n_jobs": F.count(F.lit(1))}
    series = ops.month_series(table(spark, sf_dir, "orders"), "o_orderdate", wanted, "1994-06-01", "2001-12-01")
    return series.select("month", shown("sum").alias("revenue"), "n_jobs")


@query("a01_a02_a08_a09_d74_kpis", f"""
with {JOBS}, told as (
  select org_id, revenue, state, {PERIODS} as now, {BEFORE} as past, due_on < date '2001-06-01' and state <> 'delivered' as late from jobs)
select org_id, coalesce(sum(case when now then revenue end), 0)::double as revenue, coalesce(sum(case when past then revenue end), 0)::double as revenue_before,
  count(*) filter (now and state = 'delivered') as delivered, count(*) filter (past and state = 'delivered') as delivered_before,
  count(*) filter (late) as overdue, round(count(*) filter (now and state = 'delivered')::double / nullif(count(*) filter (now), 0), 4) as delivered_rate
from told group by org_id""")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of this period and the one before, in one pass."""
    now, past = F.expr(PERIODS.replace("timestamp '", "timestamp_ntz'")), F.expr(BEFORE.replace("timestamp '", "timestamp_ntz'"))
    done = F.col("state") == "delivered"
    money = lambda when: F.coalesce(F.sum(F.when(when, F.col("revenue"))), F.lit(0))
    found = jobs(spark, sf_dir).groupBy("org_id").agg(
        shown(money(now)).alias("revenue"), shown(money(past)).alias("revenue_before"), F.count_if(now & done).alias("delivered"), F.count_if(past & done).alias("delivered_before"),
        F.count_if((F.col("due_on") < F.expr("date'2001-06-01'")) & ~done).alias("overdue"), F.count_if(now).alias("_n"),
    )
    return found.withColumn("delivered_rate", F.round(rules.ratio(F.col("delivered"), F.col("_n")), 4)).drop("_n")


@query("a03_a28_d74_jobs_by_state", f"with {JOBS} select org_id, state, count(*) as n, sum(revenue)::double as revenue from jobs group by org_id, state")
def jobs_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("org_id", "state").agg(F.count(F.lit(1)).alias("n"), shown(F.sum("revenue")).alias("revenue"))


@query("a06_a07_stage_pivot", f"""
with {JOBS}, stages(stage) as (values ('lead'), ('delivered'), ('running'), ('review'), ('lost')),
sums as (select content_type, state as stage, sum(revenue) as total, count(*) as n from jobs group by all),
types as (select distinct content_type from jobs)
select t.content_type, s.stage, coalesce(n, 0) as n, coalesce(total, 0)::double as total from types t cross join stages s left join sums u on u.stage = s.stage and u.content_type = t.content_type
union all select 'all', s.stage, coalesce(sum(n), 0)::bigint, coalesce(sum(total), 0)::double from stages s left join sums u on u.stage = s.stage group by s.stage""")
def stage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of a fixed list by content type, zeros included, with the total over types from one rollup."""
    sums = jobs(spark, sf_dir).rollup("state", "content_type").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("total")).where("state is not null")
    told = sums.select(F.col("state").alias("stage"), F.coalesce("content_type", F.lit("all")).alias("content_type"), "n", "total")
    # as many rows as there are content types and stages
    domain = told.select("content_type").distinct().select("content_type", F.explode(F.array(*map(F.lit, ("lead", "delivered", "running", "review", "lost")))).alias("stage"))
    return domain.join(told, ["content_type", "stage"], "left").select("content_type", "stage", F.coalesce("n", F.lit(0)).alias("n"), shown(F.coalesce("total", F.lit(0))).alias("total"))


@query("a10_null_bucket", f"with {SEGMENTS} select decision, count(*) as n, round(avg(score), 6) as score from segments group by decision")
def null_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null decision keeps its own bucket."""
    return segments(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("a12_a13_a44_versions", """
select lang, count(*) as n, count(distinct source) as sources, coalesce(max(doc_id), 0) + 1 as next_version from documents group by lang""")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distinct sources and the number after the last one, by language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), (F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_version"))


@query("a14_a15_queue_metrics", f"""
with {USAGE}
select kind, count(*) filter (k < 30) as ready, count(*) filter (k between 30 and 79) as running, count(*) filter (k >= 80) as dead,
  datediff('second', min("at") filter (k < 30), timestamp '2024-02-01') as oldest_age from usage group by kind""")
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items by kind and status, and the age of the oldest that is ready."""
    ready = F.col("k") < 30
    age = F.lit(1706745600) - F.unix_timestamp(F.min(F.when(ready, F.col("at"))).cast("timestamp"))
    return usage(spark, sf_dir).groupBy("kind").agg(F.count_if(ready).alias("ready"), F.count_if(F.col("k").between(30, 79)).alias("running"), F.count_if(F.col("k") >= 80).alias("dead"), age.alias("oldest_age"))


PLAN = [("click", 1000, "0.0150"), ("purchase", 200, "0.1250"), ("view", 500, "0.0075")]


@query("a16_a17_d52_usage_overage", f"""
with {USAGE}, plan(unit, included, rate) as (values {", ".join(f"('{u}', {n}, {r}::decimal(10,4))" for u, n, r in PLAN)}),
used as (select org_id, strftime("at", '%Y-%m') as period, kind as unit, count(*) as n, sum(amount) as qty from usage group by all)
select org_id, period, u.unit, n, qty::double as quantity, p.unit is null as unpriced,
  case when p.unit is not null then round(greatest(0, qty - included) * rate, 2)::double end as overage
from used u left join plan p on p.unit = u.unit""")
def usage_overage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by organisation, period and unit against a plan: what goes over is priced, rounded half up to cents."""
    plan = spark.createDataFrame(PLAN, "unit string, included int, rate string").withColumn("rate", F.col("rate").cast("decimal(10,4)"))
    used = usage(spark, sf_dir).groupBy("org_id", F.date_format("at", "yyyy-MM").alias("period"), F.col("kind").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("qty"))
    priced = used.join(F.broadcast(plan), "unit", "left")  # a plan has a few units
    over = F.round(F.greatest(F.lit(0).cast("decimal(14,2)"), (F.col("qty") - F.col("included")).cast("decimal(24,2)")) * F.col("rate"), 2)
    return priced.select("org_id", "period", "unit", "n", shown("qty").alias("quantity"), F.col("rate").isNull().alias("unpriced"), shown(over).alias("overage"))


@query("a18_f60_d50_invoice_lines", f"""
with {JOBS}, lines as (select account_id, content_type, sum(revenue) as net, count(*) as n from jobs where state = 'delivered' group by all),
taxed as (select account_id, content_type, n, net, round(net * case when account_id % 3 = 0 then 0 else 0.19 end, 2) as tax from lines)
select account_id, content_type, n, net::double as net, tax::double as tax from taxed
union all select account_id, 'total', sum(n)::bigint, sum(net)::double, sum(tax)::double from taxed group by account_id""")
def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines with tax (reverse charge: none) and each invoice's total, by a rollup."""
    lines = jobs(spark, sf_dir).where("state = 'delivered'").groupBy("account_id", "content_type").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("net"))
    rate = F.when(F.col("account_id") % 3 == 0, F.lit(0)).otherwise(F.lit(0.19)).cast("decimal(4,2)")
    taxed = lines.withColumn("tax", F.round(F.col("net") * rate, 2))
    whole = taxed.rollup("account_id", "content_type").agg(F.sum("n").alias("n"), F.sum("net").alias("net"), F.sum("tax").alias("tax")).where("account_id is not null")
    return whole.select("account_id", F.coalesce("content_type", F.lit("total")).alias("content_type"), "n", shown("net").alias("net"), shown("tax").alias("tax"))


@query("a19_d54_ledger_balances", f"""
with {USAGE}, ledger as (select 'org:' || org_id as account, amount from usage where kind in ('purchase', 'click')
  union all select case kind when 'purchase' then 'cash' else 'revenue' end, -amount from usage where kind in ('purchase', 'click'))
select account, count(*) as entries, sum(amount)::double as balance from ledger group by account""")
def ledger_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double entry: each movement is two rows that cancel; balances by account. Hot accounts are summed before the shuffle."""
    return ops.ledger(usage(spark, sf_dir).where("kind in ('purchase', 'click')"), "id", F.concat(F.lit("org:"), "org_id"), F.when(F.col("kind") == "purchase", "cash").otherwise("revenue"), "amount").groupBy("account").agg(F.count(F.lit(1)).alias("entries"), shown(F.sum("amount")).alias("balance"))


@query("a20_ledger_violations", f"""
with {USAGE}, postings as (select id, 'customer' as account, amount from usage union all select id, 'income', -amount from usage
  union all select id, 'income', 0.01 from usage where kind = 'error' and id % 7 = 0)
select id, sum(amount)::double as sum from postings group by id having sum(amount) <> 0""")
def ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that don't cancel, in a ledger where a cent was posted too much for some events."""
    rows = usage(spark, sf_dir)
    stray = rows.where((F.col("kind") == "error") & (F.col("id") % 7 == 0)).select("id", F.lit("income").alias("account"), F.lit("0.01").cast("decimal(12,2)").alias("amount"))
    rows = ops.ledger(rows, "id", F.lit("customer"), F.lit("income"), "amount").unionByName(stray)
    return rows.groupBy("id").agg(F.sum("amount").alias("sum")).where("sum != 0").select("id", shown("sum").alias("sum"))


@query("a21_w05_d51_fifo_credits", f"""
with {USAGE}, lots as (select org_id, id, "at", amount from usage where kind = 'purchase'), need as (select org_id, sum(amount) as needed from usage where kind in ('click', 'view') group by org_id),
before as (select *, coalesce(sum(amount) over (partition by org_id order by "at", id rows between unbounded preceding and 1 preceding), 0) as b from lots)
select id as lot, least(amount, greatest(0, coalesce(needed, 0) - b))::double as taken, (amount - least(amount, greatest(0, coalesce(needed, 0) - b)))::double as remaining
from before left join need using (org_id)""")
def fifo_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit lots drawn in order of age, in closed form: no lot waits for another."""
    u = usage(spark, sf_dir)
    need = u.where("kind in ('click', 'view')").groupBy("org_id").agg(F.sum("amount").alias("needed"))
    drawn = ops.fifo_draws(u.where("kind = 'purchase'"), need, ["org_id"], ["at", "id"])
    return drawn.select(F.col("id").alias("lot"), shown("take").alias("taken"), shown(F.col("amount") - F.col("take")).alias("remaining"))


HOT_USAGE = """hot as (select id, case when id % 2 = 0 then -1 else org_id end as org_id, "at", amount, kind from usage)"""


def hot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage in which one organisation has half of all rows."""
    return usage(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("org_id")).alias("org_id"), "at", "amount", "kind")


@query("w05_a21_hot_running_sums", f"""
with {USAGE}, {HOT_USAGE} select id, org_id, sum(amount) over (partition by org_id order by "at", id)::double as running from hot""")
def hot_running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums in which half of all rows are one organisation's, cut into ranges of time."""
    summed = prefix.running_sum(hot_usage(spark, sf_dir), ["org_id"], ["at", "id"], "amount", "running", least=100)
    return summed.select("id", "org_id", shown("running").alias("running"))


@query("w06_hot_first_reaching", f"""
with {USAGE}, {HOT_USAGE}, run as (select org_id, "at", sum(amount) over (partition by org_id order by "at", id) as r from hot)
select org_id, strftime(min("at"), '%Y-%m-%d %H:%M:%S') as at from run where r >= 2000 group by org_id""")
def hot_first_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each organisation's sum reaches a target."""
    reached = ops.first_reaching(hot_usage(spark, sf_dir), ["org_id"], ["at", "id"], "amount", F.lit(2000), "at", least=100)
    return reached.select("org_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("j09_hot_as_of", f"""
with {USAGE}, {HOT_USAGE}, prices as (select org_id, "at", max(amount) as price from hot where kind = 'purchase' group by org_id, "at")
select h.id, p.price::double as price from hot h asof join prices p on h.org_id = p.org_id and h."at" >= p."at" where h.kind <> 'purchase'""")
def hot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase at or before every other event, where half of all events are one organisation's."""
    u = hot_usage(spark, sf_dir)
    prices = u.where("kind = 'purchase'").select("org_id", "at", F.col("amount").alias("price"))
    return prefix.as_of(u.where("kind != 'purchase'").drop("amount"), prices, ["org_id"], "at", ["price"], least=100).select("id", shown("price").alias("price"))


@query("a22_a38_d63_payout_run", f"""
with {USAGE}, sums as (select org_id as reviewer, sum(amount) filter (kind = 'view') as earned, sum(amount) filter (kind = 'signup') as paid, count(*) filter (kind = 'error') as errors from usage group by org_id)
select reviewer, (coalesce(earned, 0) - coalesce(paid, 0))::double as balance,
  case when coalesce(earned, 0) - coalesce(paid, 0) < 50 then 'below_threshold' when errors > 200 then 'blocked' else 'pay' end as outcome from sums""")
def payout_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by reviewer and what a payout run does with them."""
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0))
    sums = usage(spark, sf_dir).groupBy(F.col("org_id").alias("reviewer")).agg((part("view") - part("signup")).alias("b"), F.count_if(F.col("kind") == "error").alias("errors"))
    return sums.select("reviewer", shown("b").alias("balance"), F.when(F.col("b") < 50, "below_threshold").when(F.col("errors") > 200, "blocked").otherwise("pay").alias("outcome"))


@query("a23_f48_d62_reviewer_score", f"""
with {USAGE}, weighed as (select org_id as reviewer, kind, pow(0.5, datediff('day', "at"::date, date '2024-03-01') / 90.0) as w from usage),
sums as (select reviewer, sum(w) filter (kind = 'purchase') as pass, sum(w) filter (kind = 'error') as fail, sum(w) filter (kind = 'signup') as escaped, count(*) as n from weighed group by reviewer)
select reviewer, n, round(100 * (7 + coalesce(pass, 0)) / (10 + coalesce(pass, 0) + 3 * coalesce(fail, 0) + coalesce(escaped, 0)), 4) as score from sums""")
def reviewer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of passed controls by reviewer with exponential decay and a prior of ten controls, failures weighing three."""
    w = rules.decay(F.datediff(F.expr("date'2024-03-01'"), F.col("at").cast("date")))
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, w)), F.lit(0.0))
    sums = usage(spark, sf_dir).groupBy(F.col("org_id").alias("reviewer")).agg(F.count(F.lit(1)).alias("n"), part("purchase").alias("p"), part("error").alias("f"), part("signup").alias("e"))
    return sums.select("reviewer", "n", F.round(100 * (7 + F.col("p")) / (10 + F.col("p") + 3 * F.col("f") + F.col("e")), 4).alias("score"))


SAMPLES = "samples as (select d.lang, 50 + (l.doc_id * 37 % 50) as score, l.quality = 0 as escaped from labels l join documents d on l.doc_id = d.doc_id)"


def control_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return found.select("lang", (50 + F.col("doc_id") * 37 % 50).cast("double").alias("score"), (F.col("quality") == 0).alias("escaped"))


@query("a24_w11_escaped_rate_grid", f"""
with {SAMPLES}, grid as (select lang, 60 + g * 0.5::double as threshold from (select distinct lang from samples where score >= 60), range(79) as r(g))
select g.lang, g.threshold, count(s.score) as n, count(s.score) filter (s.escaped) as escaped, round(count(s.score) filter (s.escaped)::double / nullif(count(s.score), 0), 6) as rate
from grid g left join samples s on s.lang is not distinct from g.lang and s.score >= g.threshold group by g.lang, g.threshold""")
def escaped_rate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped share at and above every threshold: a histogram and a reverse running sum."""
    grid = rules.calibration_grid(control_samples(spark, sf_dir), "score", "escaped", ["lang"])
    return grid.withColumn("rate", F.round("rate", 6))


@query("d46_p05_calibration", f"""
with {SAMPLES}, grid as (select lang, 60 + g * 0.5::double as threshold from (select distinct lang from samples), range(79) as r(g)),
rates as (select g.lang, g.threshold, count(s.score) as n, count(s.score) filter (s.escaped) as e from grid g left join samples s on s.lang is not distinct from g.lang and s.score >= g.threshold group by all),
ideal as (select lang, min(threshold) as t from rates where n > 0 and e::double / n <= 0.1 group by lang),
counted as (select lang, count(*) as n, count(*) filter (score >= 60) as usable from samples group by lang)
select c.lang, c.n as n_samples, case when c.n < 20 or usable = 0 then 78.0 else round(least(99.0, greatest(60.0, 78.0 + greatest(-3.0, least(3.0, coalesce(t, 81.0) - 78.0)))), 1) end::double as threshold
from counted c left join ideal i on c.lang is not distinct from i.lang""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest threshold by language that meets the target, at most three points from the current one."""
    return rules.propose_threshold(control_samples(spark, sf_dir), "score", "escaped", ["lang"], target=0.1, least_samples=20)


ERRORS = """errors as (select l_orderkey as job_id, case l_linenumber % 3 when 0 then 'accuracy' when 1 then 'fluency' else 'style' end as dimension,
  case l_returnflag when 'R' then 'major' when 'A' then 'minor' else 'neutral' end as severity, l_quantity::integer as words, l_partkey as part_id, l_suppkey as source from lineitem)"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    dimension = F.when(kind == 0, "accuracy").when(kind == 1, "fluency").otherwise("style")
    severity = F.when(F.col("l_returnflag") == "R", "major").when(F.col("l_returnflag") == "A", "minor").otherwise("neutral")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), dimension.alias("dimension"), severity.alias("severity"), F.col("l_quantity").cast("int").alias("words"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("source"))


@query("a25_f54_d45_scorecard", f"""
with {ERRORS}, sums as (select job_id, count(*) filter (severity = 'major') as major, count(*) filter (severity = 'minor') as minor, sum(words)::bigint as words,
  count(*) filter (dimension = 'accuracy' and severity <> 'neutral') as accuracy, count(*) filter (dimension = 'fluency' and severity <> 'neutral') as fluency from errors group by job_id)
select job_id, major, minor, accuracy, fluency, words, round(least(100.0, greatest(0.0, 100 - (major * 5 + minor) * 100.0 / greatest(words, 1))), 4)::double as score,
  least(100.0, greatest(0.0, 100 - (major * 5 + minor) * 100.0 / greatest(words, 1))) >= 95 as passed from sums""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by dimension and severity, the weighted penalty by hundred words, and whether the job passes."""
    real = F.col("severity") != "neutral"
    sums = errors(spark, sf_dir).groupBy("job_id").agg(
        F.count_if(F.col("severity") == "major").alias("major"), F.count_if(F.col("severity") == "minor").alias("minor"),
        F.count_if(real & (F.col("dimension") == "accuracy")).alias("accuracy"), F.count_if(real & (F.col("dimension") == "fluency")).alias("fluency"), F.sum("words").alias("words"),
    )
    score = rules.mqm_score(F.col("major") * rules.MQM_WEIGHT["major"] + F.col("minor") * rules.MQM_WEIGHT["minor"], F.col("words"))
    return sums.select("*", F.round(score, 4).alias("score"), (score >= 95).alias("passed"))


@query("a25_severity_cube", f"""
with {ERRORS} select coalesce(dimension, 'all') as dimension, coalesce(severity, 'all') as severity, count(*) as n from errors group by cube(dimension, severity)""")
def severity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by dimension and severity with all totals."""
    cube = errors(spark, sf_dir).cube("dimension", "severity").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce("dimension", F.lit("all")).alias("dimension"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


@query("a26_f74_merged_findings", f"""
with {ERRORS} select part_id, dimension, max(case severity when 'major' then 2 when 'minor' then 1 else 0 end)::integer as rank,
  string_agg(distinct source::varchar, '+' order by source::varchar) as sources from errors group by part_id, dimension""")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at one place become one, with the worst severity and all sources."""
    rank = F.when(F.col("severity") == "major", 2).when(F.col("severity") == "minor", 1).otherwise(0)
    return errors(spark, sf_dir).groupBy("part_id", "dimension").agg(F.max(rank).alias("rank"), F.array_join(F.array_sort(F.collect_set(F.col("source").cast("string"))), "+").alias("sources"))


@query("a27_r05_issue_summary", f"""
with {SEGMENTS}, coded as (select job_id, part_id, unnest(list_filter([case when words > 45 then 'length' end, case when decision is null then 'undecided' end, case when score < 60 then 'low_score' end], lambda x: x is not null)) as code from segments)
select code, count(*) as n, count(distinct job_id) as jobs from coded group by code""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by code, and the jobs that have them."""
    codes = F.array_compact(F.array(F.when(F.col("words") > 45, "length"), F.when(F.col("decision").isNull(), "undecided"), F.when(F.col("score") < 60, "low_score")))
    coded = segments(spark, sf_dir).select("job_id", F.explode(codes).alias("code"))
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"))


@query("a29_d93_provenance", f"""
with {USAGE} select org_id, k as segment, count(*) as n, string_agg(kind, '>' order by "at", id) as trail from usage group by org_id, k""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's events in order. The trail of a segment is bounded by its events; segments are many."""
    trail = F.array_sort(F.collect_list(F.struct("at", "id", "kind")))
    return usage(spark, sf_dir).groupBy("org_id", F.col("k").alias("segment")).agg(F.count(F.lit(1)).alias("n"), trail.alias("t")).select("org_id", "segment", "n", F.array_join("t.kind", ">").alias("trail"))


@query("a33_r18_org_metering", f"""
with {JOBS}, {SEGMENTS}, j as (select org_id, count(*) as jobs, sum(revenue) as revenue from jobs group by org_id),
s as (select org_id, sum(words)::bigint as words from segments join jobs on job_id = id group by org_id)
select org_id, jobs, revenue::double as revenue, coalesce(words, 0) as words from j left join s using (org_id)""")
def org_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aggregates by organisation, joined; words are summed by job before the join."""
    j = jobs(spark, sf_dir)
    words = segments(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.sum("words").alias("words"))
    return j.join(words, "id", "left").groupBy("org_id").agg(F.count(F.lit(1)).alias("jobs"), shown(F.sum("revenue")).alias("revenue"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


@query("a34_r06_threads", """
with told as (select conv_id, turn, role, first_value(role) over (partition by conv_id order by turn, role) as root_role from conversations)
select conv_id, count(*) filter (turn > 0) as replies, count(*) filter (role = 'user') as questions, max(root_role) = 'system' as resolved from told group by conv_id""")
def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by thread, with the root's flag."""
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count_if(F.col("turn") > 0).alias("replies"), F.count_if(F.col("role") == "user").alias("questions"), (F.min_by("role", F.struct("turn", "role")) == "system").alias("resolved"))


@query("a35_d80_progress", """
with keys as (select count(*) as n from benchmark), langs as (select distinct lang from documents where lang is not null),
done as (select lang, count(distinct doc_id % (select n from keys)) as done from documents where lang is not null group by lang)
select lang, n as total, coalesce(done, 0) as done, n - coalesce(done, 0) as missing, round(100.0 * coalesce(done, 0) / n, 1)::double as percent from langs cross join keys left join done using (lang)""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated keys by language against all keys."""
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    keys = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("total"))  # one row
    done = docs.crossJoin(F.broadcast(keys)).groupBy("lang", "total").agg(F.countDistinct(F.col("doc_id") % F.col("total")).alias("done"))
    return done.select("lang", "total", "done", (F.col("total") - F.col("done")).alias("missing"), F.round(100.0 * F.col("done") / F.col("total"), 1).alias("percent"))


@query("a36_j18_payables", f"""
with {SEGMENTS}, tagged as (select vendor_id, seq % 2 as currency, cost, case when done then 'paid' when decision is not null then 'invoiced' else 'accrued' end as state from segments),
sums as (select vendor_id, currency, coalesce(sum(cost) filter (state = 'accrued'), 0) as accrued, coalesce(sum(cost) filter (state = 'invoiced'), 0) as invoiced, coalesce(sum(cost) filter (state = 'paid'), 0) as paid from tagged group by all)
select vendor_id, currency::integer as currency, accrued::double as accrued, invoiced::double as invoiced, paid::double as paid from sums
union all select -1, currency::integer, sum(accrued)::double, sum(invoiced)::double, sum(paid)::double from sums group by currency""")
def payables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accrued, invoiced and paid by vendor and currency in one pass, with totals by currency."""
    tagged = segments(spark, sf_dir).select("vendor_id", (F.col("seq") % 2).alias("currency"), "cost", F.when(F.col("done"), "paid").when(F.col("decision").isNotNull(), "invoiced").otherwise("accrued").alias("state"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("cost"))), F.lit(0)).alias(s)
    sums = tagged.rollup("currency", "vendor_id").agg(*map(part, ("accrued", "invoiced", "paid"))).where("currency is not null")
    return sums.select(F.coalesce("vendor_id", F.lit(-1)).alias("vendor_id"), "currency", *(shown(s).alias(s) for s in ("accrued", "invoiced", "paid")))


@query("a37_r07_auto_invoice", f"""
with {SEGMENTS} select vendor_id, count(*) as n, count(distinct job_id) as jobs, sum(cost)::double as total,
  case when count(distinct seq % 2) = 1 then max(seq % 2)::varchar else 'XXX' end as currency, sha256(string_agg(distinct job_id::varchar, ',' order by job_id::varchar)) as jobs_digest
from segments where done group by vendor_id""")
def auto_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice a vendor: the jobs on it, their sum, and its currency if there is one only."""
    ids = F.array_join(F.array_sort(F.collect_set(F.col("job_id").cast("string"))), ",")
    own = F.col("seq") % 2
    currency = F.when(F.min(own) == F.max(own), F.max(own).cast("string")).otherwise("XXX")
    found = segments(spark, sf_dir).where("done").groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("total"), currency.alias("currency"), ids.alias("ids"))
    return found.select("vendor_id", "n", F.size(F.split("ids", ",")).cast("long").alias("jobs"), shown("total").alias("total"), "currency", F.sha2(F.col("ids").cast("binary"), 256).alias("jobs_digest"))


@query("a39_a40_d92_dataset_build", """
with rows as (select doc_id, lang, source, text, length(text) as n from documents),
latest as (select *, row_number() over (partition by md5(coalesce(text, '')) order by doc_id desc) as k from rows),
judged as (select *, case when coalesce(n, 0) = 0 then 'empty' when k > 1 then 'duplicate' when n < 40 then 'short' else 'kept' end as reason,
  ('0x' || sha256(coalesce(text, ''))[1:8])::ubigint % 10000 < 1000 as held from latest)
select lang, count(*) as n, count(*) filter (reason = 'kept' and not held) as train, count(*) filter (reason = 'kept' and held) as validation,
  count(*) filter (reason = 'duplicate') as duplicate, count(*) filter (reason = 'short') as short, count(*) filter (reason = 'empty') as empty from judged group by lang""")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows by language: the latest of equal sources, split by hash, with counts of what was dropped and why."""
    from weftline.functions.text import picked

    body = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length(body).alias("n"), F.md5(body.cast("binary")).alias("key"), picked(body, 0.1).alias("held"))
    last = rows.groupBy("key").agg(F.max("doc_id").alias("last"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("doc_id") != F.col("last"), "duplicate").when(F.col("n") < 40, "short").otherwise("kept")
    judged = rows.join(last, "key").withColumn("reason", reason)
    kept, held = F.col("reason") == "kept", F.col("held")
    return judged.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept & ~held).alias("train"), F.count_if(kept & held).alias("validation"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("duplicate", "short", "empty")))


@query("a41_account_stats", f"""
with {JOBS} select c_custkey as account_id, count(id) as projects, count(id) filter (state in ('running', 'review')) as active, coalesce(sum(revenue), 0)::double as revenue,
  coalesce(sum(revenue) filter (created_at >= timestamp '2001-05-03'), 0)::double as revenue_90d, round(coalesce(sum(revenue) filter (state = 'delivered'), 0)::double / nullif(sum(revenue), 0)::double, 4) as delivered_share
from customer left join jobs on account_id = c_custkey group by c_custkey""")
def account_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every account, those without jobs included."""
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"))
    part = lambda when: F.sum(F.when(when, F.col("revenue")).otherwise(F.lit(0)))
    recent = F.col("created_at") >= F.expr("timestamp_ntz'2001-05-03'")
    sums = jobs(spark, sf_dir).groupBy("account_id").agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.col("state").isin("running", "review")).alias("active"), F.sum("revenue").alias("r"), part(recent).alias("r90"), part(F.col("state") == "delivered").alias("rd"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return accounts.join(sums, "account_id", "left").select("account_id", zero("projects").alias("projects"), zero("active").alias("active"), shown(zero("r")).alias("revenue"), shown(zero("r90")).alias("revenue_90d"), F.round(rules.ratio(F.col("rd"), F.col("r")), 4).alias("delivered_share"))


@query("a42_member_counts", "select coalesce(r_name, 'none') as region, count(distinct n_nationkey) as nations, count(s_suppkey) as vendors from nation join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by r_name")
def member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    vendors = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("v"))
    return nations.join(vendors, "n_nationkey", "left").groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("nations"), F.coalesce(F.sum("v"), F.lit(0)).alias("vendors"))


@query("a46_org_snapshot", f"""
with {JOBS}, {USAGE}
select 'jobs' as metric, count(*)::double as value from jobs union all select 'open', count(*)::double from jobs where state <> 'delivered' union all select 'revenue', sum(revenue)::double from jobs
union all select 'accounts', count(*)::double from customer union all select 'vendors', count(*)::double from supplier union all select 'spent', sum(amount)::double from usage where kind = 'purchase'""")
def org_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small aggregates of several tables in one frame: each table is read once."""
    j = jobs(spark, sf_dir).agg(F.count(F.lit(1)).cast("double").alias("jobs"), F.count_if(F.col("state") != "delivered").cast("double").alias("open"), shown(F.sum("revenue")).alias("revenue"))
    count = lambda t, n: table(spark, sf_dir, t).agg(F.count(F.lit(1)).cast("double").alias(n))
    spent = usage(spark, sf_dir).where("kind = 'purchase'").agg(shown(F.sum("amount")).alias("spent"))
    frames = [j, count("customer", "accounts"), count("supplier", "vendors"), spent]
    told = [df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns))).alias("x")).select("x.*") for df in frames]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


@query("d47_drift", f"""
with {USAGE}, halves as (select org_id, sum(amount) filter ("at" < timestamp '2024-01-16') as base, sum(amount) filter ("at" >= timestamp '2024-01-16') as cur from usage group by org_id)
select org_id, coalesce(base, 0)::double as base, coalesce(cur, 0)::double as cur, case when coalesce(base, 0) <= 0 then coalesce(cur, 0) > 0 else abs(coalesce(cur, 0) - base)::double / base::double > 0.3 end as drift from halves""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the later half differs from the earlier one by more than three tenths."""
    late = F.col("at") >= F.expr("timestamp_ntz'2024-01-16'")
    part = lambda when: shown(F.coalesce(F.sum(F.when(when, F.col("amount"))), F.lit(0)))
    halves = usage(spark, sf_dir).groupBy("org_id").agg(part(~late).alias("base"), part(late).alias("cur"))
    return halves.withColumn("drift", rules.drifted(F.col("base"), F.col("cur")))


@query("t16_d52_period_close", f"""
with {USAGE}, days as (select org_id, strftime("at", '%Y-%m') as period, strftime("at", '%Y-%m-%d') as day, sum(amount) as amount from usage group by all)
select org_id, period, day, amount::double as amount, sum(amount) over (partition by org_id, period order by day)::double as running from days""")
def period_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums and their running total within the month."""
    days = usage(spark, sf_dir).groupBy("org_id", F.date_format("at", "yyyy-MM").alias("period"), F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.sum("amount").alias("a"))
    return days.select("org_id", "period", "day", shown("a").alias("amount"), shown(ops.running_sum("a", ["org_id", "period"], [F.col("day")])).alias("running"))
