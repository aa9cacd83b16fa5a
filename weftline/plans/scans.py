"""Scans, writes by key, predicates, sorts and set operations over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import relational as ops
from weftline.plans.registry import query, shown
from weftline.sources.tables import JOBS, SEGMENTS, USAGE, jobs, segments, table, usage


@query("s01_p01_p02_tenant_scan", f"""
with {JOBS}
select id, state, cast(revenue as double) as revenue from jobs
where org_id = 2 and state in ('running', 'review') and state not in ('cancelled')
  and created_at >= timestamp '1996-01-01' and created_at < timestamp '1998-01-01'""")
def tenant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One organisation's open jobs in a half-open window; the window reaches the scan of orders."""
    at = F.col("created_at")
    inside = (at >= F.expr("timestamp_ntz'1996-01-01'")) & (at < F.expr("timestamp_ntz'1998-01-01'"))
    found = jobs(spark, sf_dir).where((F.col("org_id") == 2) & F.col("state").isin("running", "review") & ~F.col("state").isin("cancelled") & inside)
    return found.select("id", "state", shown("revenue").alias("revenue"))


@query("s02_j01_lookup_by_key", "select o_orderkey as id, c_name as account, c_mktsegment as segment from orders join customer on o_custkey = c_custkey")
def lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's account by primary key: an equi-join instead of point reads."""
    found = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return found.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("account"), F.col("c_mktsegment").alias("segment"))


@query("s03_l07_page", f"""
with {JOBS}, paged as (select id, created_at from jobs order by created_at desc, id offset 40 limit 21),
numbered as (select id, row_number() over (order by created_at desc, id) as place, count(*) over () as n from paged)
select id, place, case when n > 20 then 60 end as next_offset from numbered where place <= 20""")
def page_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page three of twenty; a page reads one row more to know whether another follows."""
    return ops.page(jobs(spark, sf_dir).select("id", "created_at"), [F.col("created_at").desc(), F.col("id")], offset=40, limit=20).select("id", "place", "next_offset")


@query("s05_blob_keys", r"""
select page_id, 'org' || (page_id % 5) || '/pages/' || page_id || '/' || regexp_replace(coalesce(url, ''), '[^A-Za-z0-9._-]+', '_', 'g') as blob_key from pages""")
def blob_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blob keys org/kind/id/filename, with the name reduced to safe characters."""
    pages = table(spark, sf_dir, "pages")
    org = F.concat(F.lit("org"), (F.col("page_id") % 5).cast("string"))
    return pages.select("page_id", ops.blob_key(org, F.lit("pages"), F.col("page_id"), F.coalesce("url", F.lit(""))).alias("blob_key"))


@query("s06_f75_event_log", f"""
with {USAGE}
select id, to_json({{'event': kind, 'org': org_id, 'amount': cast(amount as varchar), 'at': strftime("at", '%Y-%m-%dT%H:%M:%S')}}) as entry from usage""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines for an append-only log: decimals and times become text."""
    entry = F.struct(F.col("kind").alias("event"), F.col("org_id").alias("org"), F.col("amount").cast("string").alias("amount"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return usage(spark, sf_dir).select("id", F.to_json(entry).alias("entry"))


@query("s07_t12_insert_missing", f"""
with {USAGE}, keyed as (select *, org_id || ':' || kind || ':' || strftime("at", '%Y-%m-%d') as key from usage),
old as (select key, min(id) as id from keyed where kind = 'click' group by key),
new as (select key, min(id) as id from keyed where kind in ('click', 'purchase') group by key)
select key, id, false as inserted from old union all select key, id, true from new where key not in (select key from old)""")
def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert under an idempotency key that may be repeated: keys that are there already stay as they are."""
    keyed = usage(spark, sf_dir).withColumn("key", F.concat_ws(":", "org_id", "kind", F.date_format("at", "yyyy-MM-dd")))
    firsts = lambda df: df.groupBy("key").agg(F.min("id").alias("id"))
    old = firsts(keyed.where("kind = 'click'"))
    new = firsts(keyed.where("kind in ('click', 'purchase')"))
    return old.withColumn("inserted", F.lit(False)).unionByName(ops.insert_missing(old, new, "key").withColumn("inserted", F.lit(True)))


@query("s08_upsert", """
with old as (select l_partkey as part, max(l_shipdate) as "at", count(*) as n from lineitem where l_shipdate < timestamp '1997-01-01' group by 1),
new as (select l_partkey as part, max(l_shipdate) as "at", count(*) as n from lineitem where l_shipdate >= timestamp '1997-01-01' group by 1)
select part, strftime("at", '%Y-%m-%d') as day, n from new union all
select part, strftime("at", '%Y-%m-%d'), n from old where part not in (select part from new)""")
def upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer scores replace older ones of the same key, other keys stay."""
    items, cut = table(spark, sf_dir, "lineitem"), F.expr("timestamp_ntz'1997-01-01'")
    scored = lambda df: df.groupBy(F.col("l_partkey").alias("part")).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("day"), F.count(F.lit(1)).alias("n"))
    return ops.upsert(scored(items.where(F.col("l_shipdate") < cut)), scored(items.where(F.col("l_shipdate") >= cut)), ["part"])


@query("s09_t17_budget_by_period", f"""
with {USAGE}
select org_id, kind as provider, strftime("at", '%Y-%m') as period, cast(sum(amount) as double) as spent, sum(amount) > 1000 as over from usage group by all""")
def budget_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets are sums by organisation, provider and month, so a new month starts at nothing."""
    spent = usage(spark, sf_dir).groupBy("org_id", F.col("kind").alias("provider"), F.date_format("at", "yyyy-MM").alias("period")).agg(F.sum("amount").alias("sum"))
    return spent.select("org_id", "provider", "period", shown("sum").alias("spent"), (F.col("sum") > 1000).alias("over"))


@query("s10_r03_bulk_update", """
select p_partkey as id, case when l.part is not null then 'stale' else 'active' end as status
from part left join (select distinct l_partkey as part from lineitem where l_returnflag = 'R') l on p_partkey = l.part""")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in a list of ids change their status; the rest is kept."""
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("active").alias("status"))
    named = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return ops.bulk_set(entries, named, "id", {"status": F.lit("stale")})


@query("s11_cascade_delete", """
with gone as (select c_custkey from customer where c_acctbal < 0),
kept_orders as (select * from orders where o_custkey not in (select c_custkey from gone))
select 'customer' as name, count(*) as n from customer where c_acctbal >= 0 union all select 'orders', count(*) from kept_orders
union all select 'lineitem', count(*) from lineitem where l_orderkey in (select o_orderkey from kept_orders)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting accounts deletes their jobs and the segments of those: an anti-join a level."""
    accounts, orders, items = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    gone = accounts.where("c_acctbal < 0")
    kept_orders = ops.without(orders, gone, {"o_custkey": "c_custkey"})
    kept_items = items.join(kept_orders, items["l_orderkey"] == kept_orders["o_orderkey"], "left_semi")
    counted = [df.select(F.lit(n).alias("name")) for n, df in (("customer", accounts.where("c_acctbal >= 0")), ("orders", kept_orders), ("lineitem", kept_items))]
    return counted[0].union(counted[1]).union(counted[2]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("p03_p04_p20_recent_rates", f"""
with {SEGMENTS}
select vendor_id, count(*) as n, sum(case when decision = 'auto_approve' then 1 else 0 end)::bigint as auto,
  sum(case when decision is null then 1 else 0 end)::bigint as undecided,
  round(sum(case when decision = 'auto_approve' then 1 else 0 end)::double / nullif(sum(case when decision is not null then 1 else 0 end), 0), 4) as auto_rate
from segments where delivered_at >= timestamp '1998-12-01' - interval 90 day and delivered_at < timestamp '1998-12-01' group by vendor_id""")
def recent_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the 90 days before a given day; a rate without decided segments is null."""
    day = F.expr("timestamp_ntz'1998-12-01'")
    recent = segments(spark, sf_dir).where((F.col("delivered_at") >= day - F.expr("interval 90 days")) & (F.col("delivered_at") < day))
    counted = recent.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "auto_approve").alias("auto"), F.count_if(F.col("decision").isNull()).alias("undecided"))
    return counted.withColumn("auto_rate", F.round(rules.ratio(F.col("auto"), F.col("n") - F.col("undecided")), 4))


@query("p05_p06_p07_f21_language_match", """
with pairs as (select distinct lang || case when doc_id % 3 = 0 then '-Latn' when doc_id % 3 = 1 then '_CYRL-RS' else '' end as tag from documents where lang is not null),
parts as (select tag, string_split(lower(replace(tag, '_', '-')), '-') as p from pairs),
told as (select tag, p[1] as prim, list_filter(p, lambda x: regexp_full_match(x, '[a-z]{4}'))[1] as script from parts)
select a.tag as have, b.tag as want, a.prim || case when a.script is not null then '-' || upper(a.script[1]) || a.script[2:] else '' end as canonical,
  coalesce(a.script = b.script, true) as agree, starts_with(lower(b.tag), lower(a.tag)) or starts_with(lower(a.tag), lower(b.tag)) as covers
from told a join told b on a.prim = b.prim""")
def language_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language tags that match by primary subtag, whether their scripts agree, and whether one covers the other."""
    kind = F.col("doc_id") % 3
    tags = table(spark, sf_dir, "documents").where("lang is not null").select(F.concat("lang", F.when(kind == 0, "-Latn").when(kind == 1, "_CYRL-RS").otherwise("")).alias("have")).distinct()
    told = tags.withColumn("prim", text.primary(F.col("have")))
    both = told.join(told.select(F.col("have").alias("want"), "prim"), "prim")
    low = F.lower("have"), F.lower("want")
    name = F.concat("prim", F.coalesce(F.concat(F.lit("-"), F.initcap(text.script(F.col("have")))), F.lit("")))
    return both.select("have", "want", name.alias("canonical"), text.scripts_agree(F.col("have"), F.col("want")).alias("agree"), (F.startswith(low[1], low[0]) | F.startswith(low[0], low[1])).alias("covers"))


@query("p08_p09_p10_p11_name_search", r"""
select p_partkey as id, p_name as name, lower(trim(p_name)) = lower(trim(' ' || upper(p_name))) as same, starts_with(p_type, 'STAND') as standard,
  p_brand like 'Brand#1%' as numbered, (p_name || case when p_size > 25 then ' 100%' else ' 1000' end) ilike '%100\%%' escape '\' as literal_percent from part where p_name ilike '%DGET%'""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring, equality without case, prefix and escaped searches."""
    name = F.col("p_name")
    same = F.lower(F.trim(name)) == F.lower(F.trim(F.concat(F.lit(" "), F.upper(name))))
    return table(spark, sf_dir, "part").where(name.ilike("%DGET%")).select(F.col("p_partkey").alias("id"), name.alias("name"), same.alias("same"), F.startswith("p_type", F.lit("STAND")).alias("standard"), F.col("p_brand").like("Brand#1%").alias("numbered"), F.lower(F.concat(name, F.when(F.col("p_size") > 25, " 100%").otherwise(" 1000"))).contains(text.literal("100%")).alias("literal_percent"))


@query("p12_p13_f71_json_predicates", """
select event_id as id, coalesce(cast(json_extract_string(props, '$.k') as integer), -1) as k,
  json_extract(props, '$.k') is not null as has_k, coalesce(json_array_length(json_extract(props, '$.list')), 0)::integer as n_list from events""")
def json_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with defaults, keys and array lengths of an open JSON column."""
    path = lambda p: F.get_json_object("props", p)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.coalesce(path("$.k").cast("int"), F.lit(-1)).alias("k"), path("$.k").isNotNull().alias("has_k"), F.coalesce(F.json_array_length(path("$.list")), F.lit(0)).alias("n_list"))


BAND = "case when score > 100 then 'context' when score >= 100 then 'exact' when score >= 95 then 'fuzzy_95' when score >= 85 then 'fuzzy_85' when score >= 75 then 'fuzzy_75' else 'new' end"


@query("p14_a32_words_by_band", f"""
with {SEGMENTS}, banded as (select {BAND} as band, words from segments)
select band, count(*) as n, sum(words)::bigint as words,
  round(sum(words) * case band when 'new' then 1.0 when 'fuzzy_75' then 0.8 when 'fuzzy_85' then 0.6 when 'fuzzy_95' then 0.3 else 0.1 end::double, 2) as weighted
from banded group by band""")
def words_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and weighted words of each match band."""
    counted = segments(spark, sf_dir).groupBy(rules.match_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    return counted.withColumn("weighted", F.round(F.col("words") * rules.weight(F.col("band"), rules.BAND_WEIGHT), 2))


@query("p15_r04_editor_list", f"""
with {SEGMENTS} select job_id, seq, part_id, words, count(*) over () as total from segments
where decision = 'review' and score >= 75 and score < 95 and words > 10 and done""")
def editor_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional filters: those that are not given make no predicate; the total goes with the rows."""
    chosen = ops.filtered(segments(spark, sf_dir), decision="review", score=(75, 95), words=(11, None), done=True, vendor_id=None)
    return ops.with_total(chosen.select("job_id", "seq", "part_id", "words"), "total")


@query("p16_hash_sample", """
with told as (select doc_id, sha256('control-v1:' || doc_id) as h from documents)
select doc_id, ('0x' || h[1:8])::ubigint % 10000 < 2000 as sampled from told""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that depends on the id alone: the same rows whenever and wherever it runs."""
    return table(spark, sf_dir, "documents").select("doc_id", text.picked(F.concat(F.lit("control-v1:"), "doc_id"), 0.2).alias("sampled"))


RULES = [(1, None, None, 0.10), (2, "BUILDING", None, 0.09), (3, None, "FRANCE", 0.12), (4, "BUILDING", "FRANCE", 0.08), (5, "MACHINERY", "GERMANY", 0.11), (6, "MACHINERY", None, 0.095)]


@query("p17_p18_d73_most_specific_rate", f"""
with {JOBS}, rates(rule, content_type, target_lang, rate) as (values {", ".join(str(r).replace("None", "null") for r in RULES)}),
ranked as (
  select j.id, r.rule, r.rate, row_number() over (partition by j.id order by (r.content_type is not null)::int + (r.target_lang is not null)::int desc, r.rule) as k
  from jobs j join rates r on (r.content_type is null or r.content_type = j.content_type) and (r.target_lang is null or r.target_lang = j.target_lang))
select id, rule, rate::double as rate from ranked where k = 1""")
def most_specific_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's most specific rate; a null in a rule matches everything."""
    rates = spark.createDataFrame(RULES, "rule int, content_type string, target_lang string, rate double")
    return ops.most_specific(jobs(spark, sf_dir).select("id", "content_type", "target_lang"), rates, ["content_type", "target_lang"], "rule").select("id", "rule", "rate")


@query("p19_hidden_money", f"with {JOBS} select state, count(*) as n, cast(null as double) as revenue from jobs group by state")
def hidden_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that may not see money get nulls in its place."""
    hide = True
    return jobs(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.when(F.lit(not hide), shown(F.sum("revenue"))).alias("revenue"))


@query("l01_l02_l05_ranked_queue", f"""
with {JOBS}, ranked as (select id, row_number() over (order by case state when 'review' then 0 when 'running' then 1 else 2 end,
  case when state = 'delivered' then null else due_on end asc nulls last, revenue desc, id) as place from jobs)
select id, place from ranked where place <= 100""")
def ranked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by a composite order with nulls last."""
    rank = F.when(F.col("state") == "review", 0).when(F.col("state") == "running", 1).otherwise(2)
    due = F.when(F.col("state") != "delivered", F.col("due_on"))
    return ops.ranked_top(jobs(spark, sf_dir), [rank, due.asc_nulls_last(), F.col("revenue").desc(), F.col("id")], 100).select("id", "place")


@query("l03_l06_top_accounts", """
select c_name as account, cast(sum(o_totalprice::decimal(12,2)) as double) as revenue from orders join customer on o_custkey = c_custkey
group by c_custkey, c_name order by sum(o_totalprice::decimal(12,2)) desc, lower(c_name) limit 10""")
def top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs are summed by account id before the names are joined."""
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("sum"))
    named = sums.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return named.orderBy(F.col("sum").desc(), F.lower("c_name")).limit(10).select(F.col("c_name").alias("account"), shown("sum").alias("revenue"))


@query("u01_l08_r20_exceptions_inbox", f"""
with {JOBS}, {SEGMENTS}, kinds as (
  select 'overdue' as kind, id as ref, due_on as "at" from jobs where state <> 'delivered' and due_on < date '2001-06-01'
  union all select 'in_review', id, cast(created_at as date) from jobs where state = 'review'
  union all select 'undecided', job_id, cast(max(delivered_at) as date) from segments where decision is null and not done group by job_id
), ranked as (select *, row_number() over (order by "at" desc, kind, ref) as place from kinds)
select kind, ref, strftime("at", '%Y-%m-%d') as "at", place from ranked where place <= 200""")
def exceptions_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of several kinds in one schema, newest first, one page."""
    j, s = jobs(spark, sf_dir), segments(spark, sf_dir)
    kinds = [
        j.where("state != 'delivered' and due_on < date'2001-06-01'").select(F.lit("overdue").alias("kind"), F.col("id").alias("ref"), F.col("due_on").alias("at")),
        j.where("state = 'review'").select(F.lit("in_review").alias("kind"), F.col("id").alias("ref"), F.col("created_at").cast("date").alias("at")),
        s.where("decision is null and not done").groupBy("job_id").agg(F.max("delivered_at").cast("date").alias("at")).select(F.lit("undecided").alias("kind"), F.col("job_id").alias("ref"), "at"),
    ]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return ops.ranked_top(every, [F.col("at").desc(), F.col("kind"), F.col("ref")], 200).select("kind", "ref", F.date_format("at", "yyyy-MM-dd").alias("at"), "place")


@query("u02_union_then_dedupe", f"""
with {SEGMENTS}, hits as (select part_id as id, 100.0 as score, 'exact' as kind from segments where score >= 90
  union all select part_id, score, 'fuzzy' from segments where score >= 75)
select id, score::double as score, kind from (select *, row_number() over (partition by id order by score desc, kind) as k from hits) where k = 1""")
def union_then_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several kinds, the best of each id."""
    s = segments(spark, sf_dir)
    exact = s.where("score >= 90").select(F.col("part_id").alias("id"), F.lit(100.0).alias("score"), F.lit("exact").alias("kind"))
    fuzzy = s.where("score >= 75").select(F.col("part_id").alias("id"), "score", F.lit("fuzzy").alias("kind"))
    best = exact.unionByName(fuzzy).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("score"), "b.kind")


@query("u03_d11_multiset_difference", r"""
with turns as (select conv_id, turn, regexp_extract_all(coalesce(text, ''), '[0-9]+') as numbers from conversations),
pairs as (select a.conv_id, a.turn, a.numbers as x, b.numbers as y from turns a join turns b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
counted as (select conv_id, turn, list_sort(list_distinct(list_concat(x, y))) as every, x, y from pairs),
sides as (select conv_id, turn, flatten(list_transform(every, lambda v: list_resize([v], greatest(0, len(list_filter(x, lambda w: w = v)) - len(list_filter(y, lambda w: w = v))), v))) as lost,
  flatten(list_transform(every, lambda v: list_resize([v], greatest(0, len(list_filter(y, lambda w: w = v)) - len(list_filter(x, lambda w: w = v))), v))) as added from counted)
select conv_id, turn, array_to_string(lost, ',') as lost, array_to_string(added, ',') as added, len(lost) + len(added) as penalty from sides""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers lost and added between a turn and the next, repeats counted."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.found(F.coalesce("text", F.lit("")), "[0-9]+").alias("x"))
    pairs = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    lost, added = ops.multiset_difference(F.col("x"), F.col("y")), ops.multiset_difference(F.col("y"), F.col("x"))
    return pairs.select("conv_id", "turn", F.array_join(lost, ",").alias("lost"), F.array_join(added, ",").alias("added"), (F.size(lost) + F.size(added)).cast("long").alias("penalty"))


@query("u04_u05_u07_set_operations", """
with kinds as (select user_id, list_sort(list_distinct(list(event_type))) as have from events group by user_id)
select user_id, array_to_string(list_sort(list_filter(['click', 'purchase', 'view'], lambda x: not list_contains(have, x))), ',') as missing,
  array_to_string(list_sort(list_distinct(list_concat(have, ['audit']))), ',') as every, list_has_any(have, ['error', 'signup']) as overlaps from kinds""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference, union and intersection of the kinds of event that each user has."""
    have = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    words = lambda *x: F.array(*map(F.lit, x))
    return have.select("user_id", F.array_join(F.array_sort(F.array_except(words("click", "purchase", "view"), "have")), ",").alias("missing"), F.array_join(F.array_sort(F.array_union("have", words("audit"))), ",").alias("every"), F.arrays_overlap("have", words("error", "signup")).alias("overlaps"))


@query("u06_replace_import", """
with old as (select distinct user_id, event_type from events where ts < timestamp '2024-01-16'), new as (select distinct user_id, event_type from events where ts >= timestamp '2024-01-16')
select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.event_type, n.event_type) as key, case when n.user_id is null then 'deleted' when o.user_id is null then 'created' else 'kept' end as action
from old o full join new n on o.user_id = n.user_id and o.event_type = n.event_type""")
def replace_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that replaces: keys that the new set lacks go."""
    events, cut = table(spark, sf_dir, "events"), F.expr("timestamp_ntz'2024-01-16'")
    sides = events.groupBy("user_id", F.col("event_type").alias("key")).agg(F.bool_or(F.col("ts") < cut).alias("old"), F.bool_or(F.col("ts") >= cut).alias("new"))
    return sides.select("user_id", "key", F.when(~F.col("new"), "deleted").when(~F.col("old"), "created").otherwise("kept").alias("action"))
