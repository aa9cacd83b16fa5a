"""Capacity, queues, quotes, releases, state machines, and files that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.functions import text as T
from weftline.operators import capacity
from weftline.operators import relational as ops
from weftline.plans.registry import query, shown
from weftline.plans.streams import folder
from weftline.plans.texts import PAIRS, parallel
from weftline.sources import documents as D
from weftline.sources.tables import JOBS, SEGMENTS, USAGE, jobs, segments, table, usage


@query("d60_t02_queue_claims", """
with tasks as (select c_custkey as task, c_nationkey as nation, row_number() over (partition by c_nationkey order by c_acctbal < 0 desc, c_acctbal, c_custkey) as n from customer),
workers as (select s_suppkey as worker, s_nationkey as nation, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as n from supplier)
select worker, task from workers join tasks using (nation, n)""")
def queue_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each worker claims a task of its own: the n-th worker of a nation takes the n-th task in order of urgency."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("b"))
    workers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("b"))
    first = ops.renumbered(tasks, ["nation"], [(F.col("b") < 0).desc(), F.col("b"), F.col("task")], "n")
    return ops.renumbered(workers, ["nation"], [F.col("b").desc(), F.col("worker")], "n").join(first.drop("b"), ["nation", "n"]).select("worker", "task")


LOAD = f"""{JOBS}, spans as (select account_id, id, cast(created_at as date) as a, due_on as b from jobs where state <> 'delivered'),
days as (select account_id, id, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from spans), work as (select * from days where isodow(day) < 6),
shares as (select account_id, day, 1000 // count(*) over (partition by id) as words from work), load as (select account_id, day, sum(words)::bigint as words from shares group by all)"""


@query("d70_f44_calendar", f"with {LOAD} select account_id, strftime(day, '%Y-%m-%d') as day, words, greatest(0, 400 - words)::bigint as free, words > 400 as overbooked from load")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each account's open jobs, spread over their working days, against a capacity a day."""
    return _load(spark, sf_dir).select("account_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "words", F.greatest(F.lit(0), 400 - F.col("words")).alias("free"), (F.col("words") > 400).alias("overbooked"))


def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = jobs(spark, sf_dir).where("state != 'delivered'").select("account_id", F.col("created_at").cast("date").alias("first"), F.col("due_on").alias("last"), F.lit(1000).alias("words"))
    return capacity.spread(spans, ["account_id"], "first", "last", "words")


@query("d72_deadline_risk", f"""
with {JOBS}, {SEGMENTS}, left_words as (select job_id, sum(words) filter (not done) as open, sum(words) as total from segments group by job_id)
select id, coalesce(open, 0)::bigint as open_words, greatest(1, datediff('day', date '1997-01-01', due_on))::bigint as days,
  case when state = 'delivered' or coalesce(open, 0) = 0 then 'none' when due_on < date '1997-01-01' then 'late' when coalesce(open, 0)::double / greatest(1, datediff('day', date '1997-01-01', due_on)) > 4 then 'high' when open * 2 > total then 'medium' else 'low' end as risk
from jobs left join left_words on job_id = id""")
def deadline_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each job against the days until it is due."""
    sums = segments(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.sum(F.when(~F.col("done"), F.col("words")).otherwise(0)).alias("open"), F.sum("words").alias("total"))
    joined = jobs(spark, sf_dir).join(sums, "id", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    return capacity.risk(joined, F.expr("date'1997-01-01'")).select("id", F.col("open").alias("open_words"), F.col("days").cast("long").alias("days"), "risk")


TIERS = ", ".join(f"('{t}', {r}::decimal(4,2))" for t, r in rules.TIER_RATE.items())


@query("d50_f55_quote", f"""
with {SEGMENTS}, told as (select job_id, words, case when row_number() over (partition by job_id, part_id % 7 order by n) > 1 then 'repetition' when score > 100 then 'context' when score >= 100 then 'exact' when score >= 95 then 'fuzzy_95' when score >= 85 then 'fuzzy_85' when score >= 75 then 'fuzzy_75' else 'new' end as band from segments),
weighted as (select job_id, sum(words * case band when 'new' then 1.0 when 'fuzzy_75' then 0.8 when 'fuzzy_85' then 0.6 when 'fuzzy_95' then 0.3 else 0.1 end::decimal(2,1)) as ww from told group by job_id), tiers(tier, rate) as (values {TIERS})
select job_id, tier, ww::double as weighted_words, greatest(5.00, round(ww * rate, 2))::double as price from weighted cross join tiers""")
def quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each job by tier: words weighted by match band, repetitions included, with a minimum."""
    seen = ops.renumbered(segments(spark, sf_dir).withColumn("kind", F.col("part_id") % 7), ["job_id", "kind"], [F.col("place")], "k")
    band = F.when(F.col("k") > 1, "repetition").otherwise(rules.match_band(F.col("score")))
    share = rules.weight(band, rules.BAND_WEIGHT).cast("decimal(2,1)")
    weighted = seen.groupBy("job_id").agg(F.sum(F.col("words") * share).alias("ww"))
    tiers = F.explode(F.create_map(*(F.lit(x) for pair in rules.TIER_RATE.items() for x in pair))).alias("tier", "rate")
    priced = weighted.select("job_id", "ww", tiers)
    price = F.greatest(F.lit(rules.QUOTE_MINIMUM).cast("decimal(30,2)"), F.round(F.col("ww") * F.col("rate").cast("decimal(4,2)"), 2).cast("decimal(30,2)"))
    return priced.select("job_id", "tier", shown("ww").alias("weighted_words"), shown(price).alias("price"))


@query("d82_release_digests", """
with blocks as (select p_brand as brand, p_partkey // 1000 as block, sha256(string_agg('"' || p_partkey || '":"' || p_name || '"', ',' order by p_partkey)) as digest, count(*) as n from part group by all)
select brand, sum(n)::bigint as keys, sha256(string_agg(digest, '' order by block)) as digest from blocks group by brand""")
def release_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each bundle over digests of its blocks of keys, so that no bundle is gathered whole."""
    entry = F.concat(F.lit('"'), F.col("p_partkey"), F.lit('":"'), F.col("p_name"), F.lit('"'))
    return ops.bundle_digests(table(spark, sf_dir, "part"), [F.col("p_brand").alias("brand")], F.col("p_partkey"), entry, 1000)


@query("t19_state_machine", f"""
with {USAGE}, moves as (select org_id, lag(kind) over (partition by org_id order by "at", id) as before, kind from usage),
edges(before, kind) as (values ('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view'), ('purchase', 'view'), ('click', 'view'))
select before, kind, count(*) as n, (before, kind) in (select (before, kind) from edges) as allowed from moves where before is not null group by before, kind""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves between states, and whether the table of edges has them."""
    edges = [("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("purchase", "view"), ("click", "view")]
    moves = ops.neighbours(usage(spark, sf_dir), ["org_id"], [F.col("at"), F.col("id")], ["kind"]).where("prev_kind is not null").groupBy(F.col("prev_kind").alias("before"), "kind").agg(F.count(F.lit(1)).alias("n"))
    known = F.array(*(F.lit(f"{a}>{b}") for a, b in edges))
    return moves.withColumn("allowed", F.array_contains(known, F.concat_ws(">", "before", "kind")))


@query("t08_t10_due_timers", f"""
with {USAGE} select id, case when k >= 80 then 'closed' when "at" + interval 3 day < timestamp '2024-01-20' then case when kind = 'error' then 'resolved' else 'expired' end else 'open' end as state from usage""")
def due_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputes and quotes whose time is up by a given moment."""
    due = F.col("at") + F.expr("interval 3 days") < F.expr("timestamp_ntz'2024-01-20'")
    state = F.when(F.col("k") >= 80, "closed").when(due, F.when(F.col("kind") == "error", "resolved").otherwise("expired")).otherwise("open")
    return usage(spark, sf_dir).select("id", state.alias("state"))


@query("r25_templates", "select c_custkey as id, 'Dear ' || c_name || ', your balance is ' || c_acctbal::decimal(12,2) || ' ({unknown})' as body from customer")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named places of a template filled; names without a value stay."""
    body = T.rendered("Dear {name}, your balance is {balance} ({unknown})", {"name": F.col("c_name"), "balance": F.col("c_acctbal").cast("decimal(12,2)").cast("string")})
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), body.alias("body"))


@query("s50_s51_s52_tmx", f"with {PAIRS} select distinct source, target from pairs where trim(source) <> '' and trim(target) <> ''")
def tmx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory written as TMX and read back from it."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    D.write_tmx(parallel(spark, sf_dir).where("trim(source) != '' and trim(target) != ''").select("source", "target").distinct(), path, "en-US", "de-DE")
    return D.memory_pairs(D.read_tmx(spark, path), "en", "de").select("source", "target")


@query("s53_s54_glossary_table", """
select p_partkey::varchar as source, case when p_size % 5 > 0 then p_name end as target, case p_size % 3 when 0 then 'do_not_translate' when 1 then 'mandatory' end as kind,
  case when p_size % 3 = 2 then 'unknown kind' when p_size % 3 = 1 and p_size % 5 = 0 then 'no target' end as error from part""")
def glossary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary written under other column names and read back, bad rows with their errors."""
    path, n = f"{folder(spark)}/{uuid.uuid4().hex}", F.col("p_size") % 3
    kind = F.when(n == 0, "DNT").when(n == 1, "approved").otherwise("whatever")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Term"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).alias("Translation"), kind.alias("Type"))
    rows.write.option("header", True).csv(path)
    return D.read_glossary(spark, path).select("source", "target", "kind", "error")


@query("s58_vendor_import", """
select s_suppkey::bigint as id, case when s_suppkey % 4 > 0 then s_acctbal end as rate, s_suppkey % 4 = 0 as failed from supplier""")
def vendor_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can't be read are kept with their fault instead of failing the import."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("s_acctbal").cast("string"))).write.csv(path)
    read = spark.read.schema("id long, rate double, fault string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "fault").csv(path)
    return read.select("id", "rate", F.col("fault").isNotNull().alias("failed"))


@query("s59_f30_guarded_export", "select event_id as id, case when event_type = 'click' then '''=' || event_type else event_type end as cell from events")
def guarded_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in which no cell is read as a formula."""
    path, kind = f"{folder(spark)}/{uuid.uuid4().hex}", F.col("event_type")
    D.guarded_csv(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(kind == "click", F.concat(F.lit("="), kind)).otherwise(kind).alias("cell")), path)
    return spark.read.schema("id long, cell string").option("header", True).csv(path)


SECRET = b"a secret of the tests"
_PADS = {n: "".join(f"\\x{b ^ x:02X}" for b in SECRET.ljust(64, b"\0")) for n, x in (("inner", 0x36), ("outer", 0x5C))}


@query("s04_s12_files_and_signatures", f"""
select p_brand as brand, count(*) as lines,
  sha256('{_PADS['outer']}'::blob || unhex(sha256('{_PADS['inner']}'::blob || encode('1700000000.' || p_brand || ':' || count(*))))) as signature from part group by p_brand""")
def files_and_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs written by kind and read back whole, and what a webhook would sign for each."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "part").select(F.concat_ws("\t", "p_brand", "p_name").alias("value"))
    rows.write.text(path)
    lines = D.read_files(spark, path, "part-*").select(F.explode(F.split(F.rtrim("text"), "\n")).alias("line")).where("line != ''")
    counted = lines.groupBy(F.split("line", "\t")[0].alias("brand")).agg(F.count(F.lit(1)).alias("lines"))
    return counted.withColumn("signature", T.signature(SECRET, F.lit(1_700_000_000), F.concat_ws(":", "brand", F.col("lines").cast("string"))))
