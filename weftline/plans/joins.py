"""Joins and windows: overlays, as-of versions, diffs, neighbours, running targets, planning, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators import intervals, prefix, vectors
from weftline.operators import relational as ops
from weftline.plans.registry import query, shown
from weftline.sources.tables import JOBS, SEGMENTS, USAGE, jobs, segments, table, usage


@query("j02_j21_outer_with_label", f"""
with {JOBS} select c_custkey as account_id, c_name as account, coalesce(cast(count(id) as varchar), '0') as jobs, coalesce(max(state), 'no job') as last_state
from customer left join jobs on account_id = c_custkey group by all""")
def outer_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts, with a label for what is missing."""
    sums = jobs(spark, sf_dir).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.max("state").alias("s"))
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account"))
    return accounts.join(sums, "account_id", "left").select("account_id", "account", F.coalesce(F.col("n").cast("string"), F.lit("0")).alias("jobs"), F.coalesce("s", F.lit("no job")).alias("last_state"))


@query("j03_join_then_aggregate", f"""
with {JOBS}, {SEGMENTS} select content_type, count(*) as segments, sum(words)::bigint as words, sum(cost)::double as cost from segments join jobs on job_id = id group by content_type""")
def join_then_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are summed by job first, so the join moves one row a job."""
    by_job = segments(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"), F.sum("cost").alias("c"))
    return by_job.join(jobs(spark, sf_dir).select("id", "content_type"), "id").groupBy("content_type").agg(F.sum("n").alias("segments"), F.sum("w").alias("words"), shown(F.sum("c")).alias("cost"))


@query("j04_j05_j06_semi_anti", f"""
with {JOBS}, {SEGMENTS}
select id, exists(select 1 from segments s where s.job_id = j.id and s.decision = 'review') as has_review,
  not exists(select 1 from segments s where s.job_id = j.id and not s.done) as all_done
from jobs j where account_id in (select c_custkey from customer where c_acctbal > 5000)""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS and NOT EXISTS as flags from one aggregate, and an IN list as a semi-join."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("account_id"))
    flags = segments(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.coalesce(F.bool_or(F.col("decision") == "review"), F.lit(False)).alias("r"), F.bool_or(~F.col("done")).alias("o"))
    chosen = jobs(spark, sf_dir).join(rich, "account_id", "left_semi")
    return chosen.join(flags, "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("has_review"), (~F.coalesce("o", F.lit(False))).alias("all_done"))


@query("j07_r23_seen_before", """
select distinct a.l_orderkey as job_id, a.l_suppkey as vendor_id, exists(select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_suppkey = a.l_suppkey and b.l_returnflag = 'R') as reviewed from lineitem a""")
def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the same reviewer already reviewed in the job: a self-join that becomes one aggregate."""
    return segments(spark, sf_dir).groupBy("job_id", "vendor_id").agg(F.coalesce(F.bool_or(F.col("decision") == "review"), F.lit(False)).alias("reviewed"))


@query("j08_r09_pair_cover", """
with pairs as (select distinct s_nationkey as nation, s_acctbal > 5000 as senior from supplier),
tasks as (select c_custkey as task, c_nationkey as nation, c_acctbal < 0 as hard from customer)
select t.task, count(p.nation) > 0 as covered from tasks t left join pairs p on p.nation = t.nation and (p.senior or not t.hard) group by t.task""")
def pair_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task is covered by any pair of its nation that is senior, or by any at all if it isn't hard: an equi-join on the nation."""
    pairs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.bool_or(F.col("s_acctbal") > 5000).alias("senior"))
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") < 0).alias("hard"))
    return tasks.join(pairs, "nation", "left").select("task", (F.col("senior").isNotNull() & (~F.col("hard") | F.coalesce("senior", F.lit(False)))).alias("covered"))


@query("j09_d22_as_of_version", """
with versions as (select p_brand as term, p_partkey as version, p_name as target, lead(p_partkey) over (partition by p_brand order by p_partkey) as until from part),
asked as (select l_orderkey as job_id, l_linenumber as seq, p_brand as term, l_partkey as at_version, l_suppkey as who, l_quantity as q from lineitem join part on p_partkey = l_partkey)
select job_id, seq, who, a.term, v.target, q from asked a join versions v on v.term = a.term and v.version <= a.at_version and (v.until is null or a.at_version < v.until)""")
def as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of a term that is valid for each row, without a range join: both sides are one sorted run a term."""
    part = table(spark, sf_dir, "part")
    versions = part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("version"), F.col("p_name").alias("target"))
    asked = table(spark, sf_dir, "lineitem").join(part.select("p_partkey", F.col("p_brand").alias("term")), F.col("l_partkey") == F.col("p_partkey"))
    rows = asked.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("who"), "term", F.col("l_partkey").alias("version"), F.col("l_quantity").alias("q"))
    return prefix.as_of(rows, versions, ["term"], "version", ["target"]).select("job_id", "seq", "who", "term", "target", "q")


@query("j10_d70_interval_overlap", f"""
with {JOBS}, spans as (select account_id, id, cast(created_at as date) as first, due_on as last from jobs)
select a.id, count(*) - 1 as overlaps from spans a join spans b on a.account_id = b.account_id and a.first < b.last and b.first < a.last group by a.id""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs of the same account run at the same time: counts of starts and ends, no pairs."""
    spans = jobs(spark, sf_dir).select("account_id", "id", F.col("created_at").cast("date").alias("first"), F.col("due_on").alias("last"))
    return intervals.overlap_counts(spans, ["account_id"], "first", "last", "overlaps").select("id", "overlaps")


@query("j11_w01_neighbours", f"""
with {SEGMENTS} select job_id, n as place, lag(part_id) over w as prev_part_id, lead(part_id) over w as next_part_id from segments window w as (partition by job_id order by n)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's neighbours in its job."""
    placed = ops.renumbered(segments(spark, sf_dir), ["job_id"], [F.col("place")], "n")
    return ops.neighbours(placed, ["job_id"], [F.col("n")], ["part_id"]).select("job_id", F.col("n").cast("long").alias("place"), "prev_part_id", "next_part_id")


@query("j14_f58_nearest_vectors", """
with v as (select vec_id, embedding as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings),
s as (select a.vec_id as query, b.vec_id as found, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i]::double * b.e[i]::double)) / nullif(a.norm * b.norm, 0), 6) as sim from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query order by sim desc, found) as place from s)
select query, found, sim, place from ranked where place <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by cosine for every fiftieth vector (the stated query set) among all, in blocks."""
    v = table(spark, sf_dir, "embeddings")
    return vectors.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 10)


@query("j19_d80_overlay", """
with main as (select p_partkey as key, p_name as value from part), branch as (select l_partkey as key, max(l_shipdate)::varchar as value from lineitem where l_returnflag = 'A' group by 1)
select m.key, case when b.key is null then m.value else left(b.value, 10) end as value, b.key is not null as from_branch from main m left join branch b using (key)""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch's values over the main ones."""
    main = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"), F.lit(False).alias("from_branch"))
    branch = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("key")).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("value")).withColumn("from_branch", F.lit(True))
    return ops.overlay(main, branch.join(main, "key", "left_semi"), ["key"])


@query("j20_d80_three_way_diff", """
with main as (select p_partkey as key, p_size as version, p_name as value from part),
branch as (select p_partkey as key, case when p_partkey % 3 = 0 then p_size - 1 else p_size end as base, case when p_partkey % 5 = 0 then upper(p_name) else p_name end as value from part where p_partkey % 2 = 0)
select key, case when b.value = m.value then 'same' when b.base = m.version then 'merge' else 'conflict' end as outcome from branch b join main m using (key)""")
def three_way_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch against main: unchanged, mergeable, or in conflict because main moved on."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    main = part.select(key.alias("key"), F.col("p_size").alias("version"), F.col("p_name").alias("value"))
    branch = part.where(key % 2 == 0).select(key.alias("key"), F.when(key % 3 == 0, F.col("p_size") - 1).otherwise(F.col("p_size")).alias("base"), F.when(key % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("mine"))
    return ops.merge_outcome(branch, main, "key").select("key", "outcome")


@query("w02_d50_repetitions", f"""
with {SEGMENTS}, told as (select job_id, words, row_number() over (partition by job_id, part_id % 7 order by n) > 1 as rep from segments)
select job_id, sum(words) filter (not rep)::bigint as new_words, coalesce(sum(words) filter (rep), 0)::bigint as repeated_words from told group by job_id""")
def repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a job that were seen earlier in it."""
    told = ops.renumbered(segments(spark, sf_dir).withColumn("kind", F.col("part_id") % 7), ["job_id", "kind"], [F.col("place")], "k")
    rep = F.col("k") > 1
    return told.groupBy("job_id").agg(F.sum(F.when(~rep, F.col("words"))).alias("new_words"), F.sum(F.when(rep, F.col("words")).otherwise(0)).alias("repeated_words"))


@query("w03_r11_latest_wins", f"""
with {USAGE} select org_id, id, kind from (select *, row_number() over (partition by org_id order by "at" desc, id desc) as r from usage) where r = 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each organisation, by an aggregate: a hot organisation is combined before the shuffle."""
    return usage(spark, sf_dir).groupBy("org_id").agg(F.max(F.struct("at", "id", "kind")).alias("x")).select("org_id", "x.id", "x.kind")


@query("w04_d71_planner_ranking", """
with free as (select s_suppkey as vendor, s_nationkey as nation, s_acctbal as rating, 1000 + s_suppkey % 7 * 500 as capacity, coalesce(sum(l_quantity), 0)::bigint as load from supplier left join lineitem on l_suppkey = s_suppkey and l_linestatus = 'O' group by all),
told as (select *, capacity - load % capacity as free from free)
select vendor, nation, free, row_number() over (partition by nation order by free >= 800 desc, rating desc, vendor) as rank from told""")
def planner_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors of a nation by whether they can take the work, then rating."""
    load = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("vendor")).agg(F.sum("l_quantity").cast("long").alias("load"))
    vendors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("rating"), (1000 + F.col("s_suppkey") % 7 * 500).alias("capacity"))
    free = vendors.join(load, "vendor", "left").withColumn("free", F.col("capacity") - F.coalesce("load", F.lit(0)) % F.col("capacity"))
    return ops.renumbered(free, ["nation"], [(F.col("free") >= 800).desc(), F.col("rating").desc(), F.col("vendor")], "rank").select("vendor", "nation", "free", "rank")


@query("w06_d72_finish_day", f"""
with {USAGE}, days as (select org_id, "at"::date as day, sum(amount) as a from usage group by all), run as (select *, sum(a) over (partition by org_id order by day) as r from days)
select org_id, strftime(min(day), '%Y-%m-%d') as day from run where r >= 500 group by org_id""")
def finish_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day by which a running sum reaches its target."""
    days = usage(spark, sf_dir).groupBy("org_id", F.col("at").cast("date").alias("day")).agg(F.sum("amount").alias("a"))
    return ops.first_reaching(days, ["org_id"], ["day"], "a", F.lit(500), "day").select("org_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("w07_w10_w12_top_per_group", f"""
with {SEGMENTS} select vendor_id, job_id, cost::double as cost, rank from (select *, row_number() over (partition by vendor_id order by cost desc, job_id, seq, part_id, delivered_at) as rank from segments) where rank <= 3""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest segments of each vendor: three rows a task and vendor go to the shuffle."""
    order = [F.col("cost").desc(), F.col("job_id"), F.col("seq"), F.col("part_id"), F.col("delivered_at")]
    return ops.top_per_group(segments(spark, sf_dir), ["vendor_id"], order, 3).select("vendor_id", "job_id", shown("cost").alias("cost"), "rank")


@query("w08_w09_p11_numbering", f"""
with {JOBS} select id, 'INV-' || org_id || '-' || year(created_at) || '-' || lpad(cast(row_number() over (partition by org_id, year(created_at) order by created_at, id) as varchar), 6, '0') as number from jobs""")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free invoice numbers by organisation and year; days are numbered first so that no organisation sits in one task."""
    day = F.to_date("created_at")
    rows = jobs(spark, sf_dir).select("id", "org_id", "created_at", day.alias("day"), F.year("created_at").alias("year"))
    numbered = ops.numbered_in_steps(rows, ["org_id", "year"], "day", [F.col("created_at"), F.col("id")], "n")
    return numbered.select("id", F.concat_ws("-", F.lit("INV"), "org_id", "year", F.lpad(F.col("n").cast("string"), 6, "0")).alias("number"))


@query("d42_d44_routing", f"""
with {SEGMENTS}, {JOBS}, told as (select s.*, case content_type when 'BUILDING' then 'full' when 'MACHINERY' then 'hybrid' when 'FURNITURE' then 'ai_review' else 'mt' end as tier, org_id = 3 as regulated from segments s join jobs j on j.id = s.job_id)
select tier, regulated, case when discount = 0.00 then 'blocked' when regulated or tier = 'full' then 'review'
  when tier = 'hybrid' then case when score >= 86 then 'auto_approve' when score >= 78 and score > 70 and score < 86 then 'senate' else 'review' end
  when score >= 86 then 'auto_approve' when score > 70 and score < 86 then 'senate' when tier = 'ai_review' then 'senate' else 'review' end as route, count(*) as n
from told group by all""")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where segments go, by tier and score."""
    kind = F.col("content_type")
    tier = F.when(kind == "BUILDING", "full").when(kind == "MACHINERY", "hybrid").when(kind == "FURNITURE", "ai_review").otherwise("mt")
    told = segments(spark, sf_dir).join(jobs(spark, sf_dir).select(F.col("id").alias("job_id"), tier.alias("tier"), (F.col("org_id") == 3).alias("regulated")), "job_id")
    return told.withColumn("route", rules.route(F.col("score"), F.col("discount") == 0, F.col("tier"), F.col("regulated"))).groupBy("tier", "regulated", "route").agg(F.count(F.lit(1)).alias("n"))


@query("d44_best_candidate", """
select l_orderkey as job_id, l_suppkey as candidate from (select *, row_number() over (partition by l_orderkey order by l_linenumber % 2, l_discount is null, l_discount desc, l_suppkey) as r from lineitem where l_returnflag <> 'R') where r = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of several candidates: fewest violations, then score, then order; blocked ones are out. One aggregate."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag != 'R'")
    rank = F.struct((F.col("l_linenumber") % 2).alias("v"), F.col("l_discount").isNull().alias("none"), (-F.col("l_discount")).alias("s"), F.col("l_suppkey").alias("candidate"))
    return items.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min(rank).alias("b")).select("job_id", "b.candidate")


@query("d90_r24_engine_routing", """
with scores as (select p_type as pair, l_suppkey as engine, count(*) as n, avg(l_discount::decimal(4,2))::double as s from lineitem join part on p_partkey = l_partkey group by all),
spent as (select l_suppkey as engine, sum(l_extendedprice::decimal(12,2)) as spent from lineitem group by 1),
ok as (select *, row_number() over (partition by pair order by round(s, 8) desc, n desc, engine) as r from scores join spent using (engine) where n >= 3 and spent < 30000000)
select pair, engine from ok where r = 1""")
def engine_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored engine of each pair with enough samples and budget left."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("engine"), F.col("l_discount").cast("decimal(4,2)").alias("d"), F.col("l_extendedprice").cast("decimal(12,2)").alias("c"))
    left = items.groupBy("engine").agg(F.sum("c").alias("spent")).where("spent < 30000000").select("engine")
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("pair"))
    scores = items.join(pairs, "l_partkey").groupBy("pair", "engine").agg(F.count(F.lit(1)).alias("n"), F.round(shown(F.sum("d")) / F.count(F.lit(1)), 8).alias("s")).where("n >= 3")
    best = scores.join(left, "engine", "left_semi").groupBy("pair").agg(F.max(F.struct("s", "n", (-F.col("engine")).alias("e"))).alias("b"))
    return best.select("pair", (-F.col("b.e")).alias("engine"))


@query("d91_fallback_chain", """
select p_partkey as id, coalesce(case when p_size % 3 = 0 then 'first' end, case when p_size % 2 = 0 then 'second' end, 'default') as engine from part""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine that answered."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.when(size % 3 == 0, "first"), F.when(size % 2 == 0, "second"), F.lit("default")).alias("engine"))


@query("d94_audit_query", f"""
with {USAGE} select id, org_id, kind from usage where starts_with(kind, 'p') and "at" >= timestamp '2024-01-10' and "at" < timestamp '2024-01-20'""")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries by action prefix and time."""
    at = F.col("at")
    return usage(spark, sf_dir).where(F.startswith("kind", F.lit("p")) & (at >= F.expr("timestamp_ntz'2024-01-10'")) & (at < F.expr("timestamp_ntz'2024-01-20'"))).select("id", "org_id", "kind")


@query("r01_r02_split_and_renumber", f"""
with {SEGMENTS}, halves as (select job_id, n, h, case when h = 0 then words - words // 2 else words // 2 end as words from segments, range(2) as t(h) where h = 0 or words > 40)
select job_id, row_number() over (partition by job_id order by n, h) as seq, words from halves""")
def split_and_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long segments split in two; all are renumbered within their job."""
    half = (F.col("words") / 2).cast("int")
    parts = F.when(F.col("words") > 40, F.array(F.struct(F.lit(0).alias("h"), (F.col("words") - half).alias("w")), F.struct(F.lit(1).alias("h"), half.alias("w")))).otherwise(F.array(F.struct(F.lit(0).alias("h"), (F.col("words") - half).alias("w"))))
    split = segments(spark, sf_dir).select("job_id", "place", F.explode(parts).alias("x")).select("job_id", "place", "x.h", F.col("x.w").alias("words"))
    return ops.renumbered(split, ["job_id"], [F.col("place"), F.col("h")], "seq").select("job_id", "seq", "words")


@query("r02_s47_regroup_slots", f"""
with {SEGMENTS} select job_id, (n - 1) // 2 as slot, sum(words)::bigint as words, string_agg(part_id::varchar, ' ' order by n) as merged from segments group by all""")
def regroup_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours merge into slots of two, their texts joined in order."""
    placed = ops.renumbered(segments(spark, sf_dir), ["job_id"], [F.col("place")], "n")
    merged = F.array_sort(F.collect_list(F.struct("n", F.col("part_id").cast("string").alias("t"))))
    slots = placed.groupBy("job_id", ((F.col("n") - 1) / 2).cast("long").alias("slot")).agg(F.sum("words").alias("words"), merged.alias("m"))
    return slots.select("job_id", "slot", "words", F.array_join("m.t", " ").alias("merged"))


@query("r08_t12_replay_conflicts", f"""
with {USAGE}, keyed as (select id, "at", org_id || ':' || strftime("at", '%Y-%m-%d') as key, md5(kind) as body from usage),
firsts as (select *, first_value(body) over (partition by key order by "at", id) as original, row_number() over (partition by key order by "at", id) as r from keyed)
select id, case when r = 1 then 'stored' when body = original then 'replayed' else 'conflict' end as outcome from firsts""")
def replay_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under a key: the first is stored, equal ones replay it, others conflict."""
    keyed = usage(spark, sf_dir).select("id", "at", F.concat_ws(":", "org_id", F.date_format("at", "yyyy-MM-dd")).alias("key"), F.md5(F.col("kind").cast("binary")).alias("body"))
    firsts = keyed.groupBy("key").agg(F.min(F.struct("at", "id", "body")).alias("f"))
    outcome = F.when(F.col("id") == F.col("f.id"), "stored").when(F.col("body") == F.col("f.body"), "replayed").otherwise("conflict")
    return keyed.join(firsts, "key").select("id", outcome.alias("outcome"))


@query("r10_r19_d53_entitlements", """
with had as (select user_id, list_sort(list_distinct(list(event_type))) as base from events group by user_id),
told as (select user_id, list_distinct(list_concat(base, case when list_contains(base, 'purchase') then ['billing', 'invoices'] else ['billing'] end)) as plan from had)
select user_id, array_to_string(list_sort(list_filter(plan, lambda x: x <> 'error')), ',') as modules, coalesce(list_position(list_sort(plan), 'billing') < list_position(list_sort(plan), 'view'), false) as ordered from told""")
def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan modules with what they depend on, less what was removed; and an order that must hold."""
    have = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("base"))
    needs = F.when(F.array_contains("base", "purchase"), F.array(F.lit("billing"), F.lit("invoices"))).otherwise(F.array(F.lit("billing")))
    plan = F.array_sort(F.array_union("base", needs))
    place = lambda x: F.nullif(F.array_position(plan, x), F.lit(0))
    return have.select("user_id", F.array_join(F.array_remove(plan, "error"), ",").alias("modules"), F.coalesce(place("billing") < place("view"), F.lit(False)).alias("ordered"))


@query("r12_r13_r14_import_actions", """
with old as (select l_partkey as key, max(l_quantity) as value from lineitem where l_shipdate < timestamp '1998-01-01' group by 1), new as (select l_partkey as key, max(l_quantity) as value from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1)
select coalesce(o.key, n.key) as key, case when o.key is null then 'created' when n.key is null then 'archived' when o.value = n.value then 'unchanged' else 'updated' end as action, (1 + (o.key is not null and n.key is not null and o.value <> n.value)::int)::integer as version from old o full join new n on o.key = n.key""")
def import_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import does to each key; only a change raises the version."""
    items, cut = table(spark, sf_dir, "lineitem"), F.expr("timestamp_ntz'1998-01-01'")
    old = F.max(F.when(F.col("l_shipdate") < cut, F.col("l_quantity")))
    new = F.max(F.when(F.col("l_shipdate") >= cut, F.col("l_quantity")))
    both = items.groupBy(F.col("l_partkey").alias("key")).agg(old.alias("o"), new.alias("n"))
    action = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "archived").when(F.col("o") == F.col("n"), "unchanged").otherwise("updated")
    return both.select("key", action.alias("action")).withColumn("version", F.when(F.col("action") == "updated", 2).otherwise(1))


@query("r16_r21_quote_estimate", f"""
with {SEGMENTS}, {JOBS} select id, greatest(5.00, coalesce(sum(words), 0) * 0.07::decimal(4,2))::double as price, (coalesce(sum(words), 0) // 20000 + 1)::bigint as days from jobs left join segments on job_id = id group by id""")
def quote_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a job by words with a minimum, and its days."""
    words = segments(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.sum("words").alias("w"))
    w = F.coalesce("w", F.lit(0))
    price = F.greatest(F.lit(rules.QUOTE_MINIMUM).cast("decimal(24,2)"), (w * F.lit("0.07").cast("decimal(4,2)")).cast("decimal(24,2)"))
    return jobs(spark, sf_dir).select("id").join(words, "id", "left").select("id", shown(price).alias("price"), (F.floor(w / 20000) + 1).alias("days"))


@query("r17_r22_name_in_text", """
with told as (select n_name as name, 'Please plan for ' || lower(n_name) || ' and ' || lower(r_name) as text from nation join region on n_regionkey = r_regionkey)
select t.text, max_by(n.n_name, length(n.n_name) * 100 - n.n_nationkey) as found from told t join nation n on contains(lower(t.text), lower(n.n_name)) group by t.text""")
def name_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name that a text holds."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    told = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("Please plan for "), F.lower("n_name"), F.lit(" and "), F.lower("r_name")).alias("text"))
    return ops.longest_name(told, "text", nations.select("n_name", "n_nationkey"), "n_name", "n_nationkey").select("text", F.col("n_name").alias("found"))


@query("t13_barrier", f"""
with {SEGMENTS} select job_id, count(*) filter (not done) as open, count(*) filter (not done) = 0 as ready, strftime(max(delivered_at), '%Y-%m-%d') as last from segments group by job_id""")
def barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose last open segment is done may go on."""
    return segments(spark, sf_dir).groupBy("job_id").agg(F.count_if(~F.col("done")).alias("open"), F.date_format(F.max("delivered_at"), "yyyy-MM-dd").alias("last")).withColumn("ready", F.col("open") == 0)


@query("t03_t15_consecutive_failures", f"""
with {USAGE}, runs as (select *, count(*) filter (kind <> 'error') over (partition by org_id order by "at", id) as island from usage),
lengths as (select org_id, island, count(*) filter (kind = 'error') as n from runs group by all)
select org_id, max(n) as longest, max(n) >= 5 as disabled, least(1800, 5 * pow(2, greatest(max(n), 1) - 1))::integer as backoff from lengths group by org_id""")
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of failures by organisation, whether it disables the hook, and the wait after it."""
    order = Window.partitionBy("org_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    runs = usage(spark, sf_dir).withColumn("island", F.sum((F.col("kind") != "error").cast("int")).over(order))
    lengths = runs.groupBy("org_id", "island").agg(F.count_if(F.col("kind") == "error").alias("n")).groupBy("org_id").agg(F.max("n").alias("longest"))
    return lengths.select("org_id", "longest", (F.col("longest") >= 5).alias("disabled"), rules.backoff_seconds(F.greatest("longest", F.lit(1))).alias("backoff"))


@query("t07_t09_t10_expired_holds", f"""
with {USAGE}, held as (select id, org_id, "at", lead("at") over (partition by org_id order by "at", id) as next from usage)
select id, case when next is null or next > "at" + interval 10 minute then 'expired' else 'released' end as outcome, strftime(least(coalesce(next, "at" + interval 10 minute), "at" + interval 10 minute), '%Y-%m-%d %H:%M:%S') as ends from held""")
def expired_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds end with the next event of their organisation or after ten minutes."""
    held = ops.neighbours(usage(spark, sf_dir), ["org_id"], [F.col("at"), F.col("id")], ["at"])
    limit = F.col("at") + F.expr("interval 10 minutes")
    return held.select("id", F.when(F.col("next_at").isNull() | (F.col("next_at") > limit), "expired").otherwise("released").alias("outcome"), F.date_format(F.least(F.coalesce("next_at", limit), limit), "yyyy-MM-dd HH:mm:ss").alias("ends"))
