"""Text functions, translation memory, terminology, dates and money on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import dates, rules
from weftline.functions import text as T
from weftline.operators import memory
from weftline.plans.registry import query
from weftline.sources.tables import JOBS, jobs, table

SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
LINES = r"""lines as (select doc_id, lang, seq, line from (select doc_id, lang, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as seq from documents) where trim(line) <> '')"""
KEYS = f"""keyed as (select doc_id, lang, seq, sha256(coalesce(lang, '') || chr(31) || lower({SQUEEZE.format('line')})) as source_key,
  sha256(coalesce({SQUEEZE.format('lag(line) over w')}, '') || chr(30) || coalesce({SQUEEZE.format('lead(line) over w')}, '')) as context_key from lines window w as (partition by doc_id order by seq))"""


@query("f01_f04_source_keys", f"with {LINES}, {KEYS} select doc_id, seq, source_key, context_key from keyed")
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of each line's normal form and of its neighbours."""
    lines = memory.lines_of(table(spark, sf_dir, "documents"))
    return memory.contexts(lines, "doc_id", "seq", "line").select("doc_id", F.col("seq").cast("long").alias("seq"), "source_key", "context_key")


@query("f05_tagged_text", r"""
with tagged as (select conv_id, turn, '⟦1⟧' || replace(replace(coalesce(text, ''), '⟦', '⟦⟦'), '⟧', '⟧⟧') || '⟦/1⟧ ⟦2/⟧' as x from conversations)
select conv_id, turn, replace(replace(regexp_replace(replace(replace(x, '⟦⟦', chr(1)), '⟧⟧', chr(2)), '⟦/?[A-Za-z0-9_.-]+/?⟧', '', 'g'), chr(1), '⟦'), chr(2), '⟧') as plain,
  array_to_string(regexp_extract_all(replace(replace(x, '⟦⟦', chr(1)), '⟧⟧', chr(2)), '⟦/?[A-Za-z0-9_.-]+/?⟧'), ' ') as codes from tagged""")
def tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text and inline codes of tagged text whose brackets are doubled where they are meant."""
    rows = table(spark, sf_dir, "conversations")
    tagged = F.concat(F.lit("⟦1⟧"), T.escape_brackets(F.coalesce("text", F.lit(""))), F.lit("⟦/1⟧ ⟦2/⟧"))
    return rows.select("conv_id", "turn", T.plain(tagged).alias("plain"), F.array_join(T.codes(tagged), " ").alias("codes"))


@query("f07_f10_word_counts", rf"""
select doc_id, case when {SQUEEZE.format("coalesce(text, '')")} = '' then 0 else len(string_split({SQUEEZE.format("coalesce(text, '')")}, ' ')) end as by_space,
  len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+')) as by_word,
  greatest(1, ceil(len(regexp_extract_all(coalesce(text, ''), '[\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}]')) / 2.0)::bigint + len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}]', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'))) as by_script from documents""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways of counting words: by spaces, by runs of letters and digits, and with half a word a CJK character."""
    x = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.space_words(x).cast("long").alias("by_space"), T.word_count(x).cast("long").alias("by_word"), T.script_words(x).cast("long").alias("by_script"))


@query("f12_edit_distance", """
select a.n_nationkey as a, b.n_nationkey as b, round(levenshtein(a.n_name, b.n_name)::double / greatest(length(a.n_name), length(b.n_name)), 6) as distance from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised Levenshtein distance of the names of one region."""
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(x), F.col("n_name").alias(f"{x}_name"), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.round(T.edit_distance(F.col("a_name"), F.col("b_name")), 6).alias("distance"))


TRIGRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("f13_j13_d12_l04_trigram_join", f"""
with names as (select distinct p_name || ' ' || p_brand as name from part), told as (select name, {TRIGRAMS.format('name')} as g from names),
pairs as (select a.name as query, b.name as id, len(list_intersect(a.g, b.g)) as c, len(a.g) + len(b.g) as n from told a join told b on a.name <> b.name)
select query, id, round(c::double / (n - c), 6) as sim from (select *, row_number() over (partition by query order by c::double / (n - c) desc, id) as r from pairs where c::double / (n - c) >= 0.5) where r <= 5""")
def trigram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar names of each name, by trigrams, at 0.5 or more. Words are those of the SQL: ASCII letters and digits."""
    from weftline.operators import relational as ops

    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("text")).distinct()
    found = memory.similar_pairs(names.select(F.col("text").alias("query"), "text"), names.select(F.col("text").alias("id"), "text"), 0.5, T.ASCII_LETTERS).where("query != id")
    return ops.top_per_group(found, ["query"], [F.col("sim").desc(), F.col("id")], 5).select("query", "id", F.round("sim", 6).alias("sim"))


@query("f16_f29_extraction", r"""
select page_id, len(regexp_extract_all(html, 'https?://[^\s<>]+')) as urls, len(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as emails,
  len(regexp_extract_all(html, '[0-9]+(?:[.,][0-9]+)*')) as numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\{[a-z]+\}'))), ',') as placeholders from pages""")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, addresses, numbers and placeholders."""
    n = lambda p: F.size(T.found(F.col("html"), p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n(T.URL).alias("urls"), n(T.EMAIL).alias("emails"), n(T.NUMBER).alias("numbers"), F.array_join(F.array_sort(F.array_distinct(T.found(F.col("html"), r"\{[a-z]+\}"))), ",").alias("placeholders"))


@query("f18_f20_d40_surface_checks", rf"""
with {LINES}, p as (select doc_id, seq, line, lead(line) over (partition by doc_id order by seq) as next from lines),
told as (select *, regexp_replace(line, '["''”»)\]\s]+$', '') as a, regexp_replace(next, '["''”»)\]\s]+$', '') as b from p where next is not null)
select doc_id, seq, (case when regexp_matches(a, '[.。]$') then 'stop' when regexp_matches(a, '[?？;]$') then 'question' when regexp_matches(a, '[!！]$') then 'shout' else 'none' end)
  <> (case when regexp_matches(b, '[.。]$') then 'stop' when regexp_matches(b, '[?？;]$') then 'question' when regexp_matches(b, '[!！]$') then 'shout' else 'none' end) as punctuation_end,
  contains(next, '  ') and not contains(line, '  ') as double_space, regexp_extract(line, '^[ \t]*') <> regexp_extract(next, '^[ \t]*') as whitespace,
  line = next as untranslated, length(next) > 2 * length(line) as length from told""")
def surface_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that need no rules of a language: each line against the next as if it were its translation."""
    from weftline.operators import relational as ops

    lines = memory.lines_of(table(spark, sf_dir, "documents"))
    pairs = ops.neighbours(lines, ["doc_id"], [F.col("seq")], ["line"]).where("next_line is not null")
    a, b = F.col("line"), F.col("next_line")
    return pairs.select("doc_id", F.col("seq").cast("long").alias("seq"), *(c.alias(n) for n, c in T.surface_checks(a, b).items()))


def _plural_values() -> str:
    """The table of plurals as SQL rows."""
    optional = rules.MANY_IS_OPTIONAL.split()
    gettext = {lang: forms for forms, langs in rules.GETTEXT_FORMS.items() for lang in langs.split()}
    told = lambda forms: "string_split('" + forms + "', ' ')"
    needed = lambda lang, forms: " ".join(f for f in forms.split() if f != "many" or lang not in optional)
    return ", ".join(f"('{lang}', {told(forms)}, {told(needed(lang, forms))}, {told(gettext.get(lang, needed(lang, forms)))})" for forms, langs in rules.PLURALS.items() for lang in langs.split())


#: Tags under which the documents are looked at, so that every set of categories comes up, and languages out of the table.
PLURAL_TAGS = "ar be cs-CZ de en_GB fr ga he ja lt lv pl pt-BR ro ru sl sr-Latn tlh xx zh-Hant".split()


@query("f25_plural_forms", f"""
with forms(lang, categories, required, gettext) as (values {_plural_values()}),
have as (
  select doc_id, ({PLURAL_TAGS})[(doc_id % {len(PLURAL_TAGS)} + 1)::bigint] as tag,
    case doc_id % 3 when 0 then ['one', 'other'] when 1 then ['other', '=0', 'few'] else ['many', 'one', 'two'] end as given from documents
), told as (
  select doc_id, tag, given, coalesce(categories, ['one', 'other']) as categories, coalesce(required, ['one', 'other']) as required, coalesce(gettext, ['one', 'other']) as gettext
  from have left join forms on lang = string_split(lower(replace(tag, '_', '-')), '-')[1]
)
select doc_id, tag, array_to_string(list_filter(required, lambda x: not list_contains(given, x)), ',') as missing,
  array_to_string(list_sort(list_filter(given, lambda x: not starts_with(x, '=') and not list_contains(categories, x))), ',') as surplus,
  array_to_string(gettext, ',') as gettext,
  array_to_string(list_transform(required, lambda x: x || '<' || case when list_contains(given, x) then x when list_contains(given, 'other') then 'other' else given[1] end), ',') as sources
from told""")
def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plural categories that a translation still lacks or has too many of, and the source form that each is made from."""
    n = F.col("doc_id") % 3
    forms = lambda *x: F.array(*map(F.lit, x))
    given = F.when(n == 0, forms("one", "other")).when(n == 1, forms("other", "=0", "few")).otherwise(forms("many", "one", "two"))
    tag = F.element_at(forms(*PLURAL_TAGS), (F.col("doc_id") % len(PLURAL_TAGS) + 1).cast("int"))
    docs = rules.plural_forms(table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag"), given.alias("given")), "tag")
    gaps = rules.plural_gaps(F.col("required"), F.col("categories"), F.col("given"))
    sources = F.transform("required", lambda x: F.concat_ws("<", x, rules.source_form(x, F.col("given"))))
    joined = lambda c: F.array_join(c, ",")
    return docs.select("doc_id", "tag", joined(gaps["missing"]).alias("missing"), joined(gaps["surplus"]).alias("surplus"), joined("gettext").alias("gettext"), joined(sources).alias("sources"))


@query("f26_iban_check", """
with told as (select c_custkey as id, lpad(c_custkey::varchar, 18, '0') as bban from customer)
select id, 'DE' || lpad((98 - (bban || '131400')::hugeint % 97)::varchar, 2, '0') || bban as iban, true as valid, 98 - (bban || '131400')::hugeint % 97 = (id % 90) + 2 as other_valid from told""")
def iban_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits: a right account number passes, one with other digits passes only by being the same."""
    bban = F.lpad(F.col("c_custkey").cast("string"), 18, "0")
    right = F.lpad((98 - T.mod97(F.concat(bban, F.lit("131400")))).cast("string"), 2, "0")
    wrong = F.lpad((F.col("c_custkey") % 90 + 2).cast("string"), 2, "0")
    iban = F.concat(F.lit("DE"), right, bban)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), iban.alias("iban"), T.iban_valid(iban).alias("valid"), T.iban_valid(F.concat(F.lit("DE"), wrong, bban)).alias("other_valid"))


@query("f28_f30_f22_conversions", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace('⟦1⟧' || page_id || '⟦/1⟧⟦2/⟧', '⟦([0-9]+)⟧', '<g id="\1">', 'g'), '⟦/[0-9]+⟧', '</g>', 'g'), '⟦([0-9]+)/⟧', '<x id="\1"/>', 'g') as markup,
  case when regexp_matches(url, '^[=+\-@]') then '''' || url else url end as guarded, translate(lower(url), 'àâäçéèêëîïôöùûüß', 'aaaceeeeiioouuus') as folded from pages""")
def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline codes as markup, guarded spreadsheet cells, folded accents."""
    code = F.concat(F.lit("⟦1⟧"), "page_id", F.lit("⟦/1⟧⟦2/⟧"))
    return table(spark, sf_dir, "pages").select("page_id", T.to_markup(code).alias("markup"), T.formula_guard(F.col("url")).alias("guarded"), T.fold(F.col("url")).alias("folded"))


@query("f40_f46_dates", f"""
with {JOBS} select id, strftime(created_at, '%Y-%m') as period, greatest(0, floor(datediff('second', timestamp '2001-06-01', due_on::timestamp) / 60.0))::bigint as minutes_left,
  round(greatest(0, datediff('second', due_on::timestamp, timestamp '2001-06-01')) / 3600.0, 1)::double as hours_over, strftime(created_at::date + interval 1 month, '%Y-%m-%d') as next_month,
  (isodow(created_at) - 1 < 5) as workday, least(7200, (0.2 * greatest(0, datediff('second', created_at::date::timestamp, due_on::timestamp)))::bigint) as lead from jobs""")
def job_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods, deadlines, a month later with the day clamped, workdays and the lead before a deadline."""
    now, due, day = F.expr("timestamp_ntz'2001-06-01'"), F.col("due_on"), F.col("created_at").cast("date")
    return jobs(spark, sf_dir).select(
        "id", dates.period(F.col("created_at")).alias("period"), dates.minutes_left(due, now).alias("minutes_left"), dates.hours_over(due, now).alias("hours_over"), F.date_format(F.add_months(day, 1), "yyyy-MM-dd").alias("next_month"),
        (F.weekday("created_at") < 5).alias("workday"), dates.deadline_lead(day, due).alias("lead"),
    )


@query("f50_f53_rounding", """
select l_orderkey as job, l_linenumber as line, l_partkey as part, l_suppkey as supplier, l_quantity as q, round(l_extendedprice::decimal(12,2) * 0.125, 2)::double as half_up,
  ceil(l_extendedprice::decimal(12,2) * 0.0013337 * 100) / 100 as up from lineitem""")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents half up and cents always up, in decimals."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    up = F.ceil(price * F.lit("0.0013337").cast("decimal(9,7)") * 100).cast("double") / 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("q"), F.round(price * F.lit("0.125").cast("decimal(4,3)"), 2).cast("double").alias("half_up"), up.alias("up"))


@query("f55_f56_d50_pay_and_fee", """
select l_orderkey as job, l_linenumber as line, l_partkey as part, l_suppkey as supplier, l_quantity as q, round(greatest(0.02, case when l_returnflag = 'R' then 0.01 + l_quantity * 0.012 * (case when l_tax >= 0.08 then 1.5 when l_tax >= 0.06 then 1.25 else 1 end) else l_quantity * 0.004 * (case when l_tax >= 0.08 then 1.5 when l_tax >= 0.06 then 1.25 else 1 end) end), 5) as pay,
  round(l_extendedprice::decimal(12,2) * least(0.080::decimal(6,3), 0.050::decimal(6,3) + l_discount::decimal(4,2) * 0.1::decimal(2,1)), 2)::double as fee from lineitem""")
def pay_and_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer pay by words, edits and level; the platform's fee, capped."""
    level = F.when(F.col("l_tax") >= 0.08, 4).when(F.col("l_tax") >= 0.06, 3).otherwise(1)
    pay = rules.review_pay(F.col("l_quantity"), F.col("l_returnflag") == "R", level)
    exact = lambda x: F.lit(x).cast("decimal(6,3)")
    share = F.least(exact("0.08"), (exact("0.05") + F.col("l_discount").cast("decimal(4,2)") * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(6,3)"))
    fee = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * share, 2).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("q"), F.round(pay, 5).alias("pay"), fee.alias("fee"))


@query("f61_longest_prefix_rate", """
with rates(prefix, rate) as (values ('Brand#', 1.0), ('Brand#1', 1.5), ('Brand#12', 2.0), ('Brand#2', 1.2))
select p_partkey as id, max_by(rate, length(prefix))::double as rate from part join rates on starts_with(p_brand, prefix) group by p_partkey""")
def longest_prefix_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of the longest prefix: every row looks up its own prefixes in a map of the few rates."""
    rates = {"Brand#": 1.0, "Brand#1": 1.5, "Brand#12": 2.0, "Brand#2": 1.2}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.longest_prefix(F.col("p_brand"), rates).alias("rate")).where("rate is not null")


@query("f70_f72_d82_canonical_json", """
select c_custkey as id, '{"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '","tier":"' || case when c_acctbal > 5000 then 'gold' else 'base' end || '"}' as body,
  sha256('{"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '","tier":"' || case when c_acctbal > 5000 then 'gold' else 'base' end || '"}') as digest from customer""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted keys without spaces, and the digest of that; defaults are overridden first."""
    defaults = F.create_map(F.lit("tier"), F.lit("base"))
    own = F.when(F.col("c_acctbal") > 5000, F.create_map(F.lit("tier"), F.lit("gold"))).otherwise(F.create_map().cast("map<string,string>"))
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.element_at(T.merged(defaults, own), "tier").alias("tier")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"))


@query("d10_j12_match_ladder", f"""
with {LINES}, {KEYS}, old as (select distinct source_key, context_key from keyed where doc_id % 3 = 0)
select doc_id, seq, case when exists(select 1 from old o where o.source_key = k.source_key and o.context_key = k.context_key) then 101.0
  when source_key in (select source_key from old) then 100.0 else 0.0 end::double as score from keyed k where doc_id % 3 <> 0""")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two thirds of the documents against a memory of the other third: in context, exact, or new."""
    keyed = memory.contexts(memory.lines_of(table(spark, sf_dir, "documents")), "doc_id", "seq", "line")
    third = F.col("doc_id") % 3 == 0
    return memory.exact_matches(keyed.where(~third), keyed.where(third)).select("doc_id", F.col("seq").cast("long").alias("seq"), "score")


PAIRS = "pairs as (select a.conv_id, a.turn, coalesce(a.text, '') as source, coalesce(b.text, '') as target from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"


def parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and the assistant turns that follow them."""
    rows = table(spark, sf_dir, "conversations")
    after = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("target"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("source")).join(after, ["conv_id", "turn"])


@query("d14_memory_upsert", f"""
with {PAIRS}, old as (select source as k, min(target) as target, min(conv_id) % 2 = 0 as reviewed from pairs where conv_id % 3 <> 1 group by source),
new as (select source as k, max(target) as target, max(conv_id) % 5 <> 0 as imported from pairs where conv_id % 3 <> 0 group by source)
select sha256(n.k) as id, case when o.k is null then 'inserted' when o.target = n.target then 'unchanged' when o.reviewed and n.imported then 'kept' else 'updated' end as action from new n left join old o on o.k = n.k""")
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new pairs do to a memory; imports never replace reviewed targets."""
    pairs = parallel(spark, sf_dir)
    old = pairs.where("conv_id % 3 != 1").groupBy("source").agg(F.min("target").alias("target"), (F.min("conv_id") % 2 == 0).alias("reviewed"))
    new = pairs.where("conv_id % 3 != 0").groupBy("source").agg(F.max("target").alias("target"), (F.max("conv_id") % 5 != 0).alias("imported"))
    return memory.upsert_actions(old, new, ["source"]).select(F.sha2(F.col("source").cast("binary"), 256).alias("id"), "action")


@query("a11_d15_inconsistencies", f"""
with pairs as (select case when p_partkey % 2 = 0 then upper(p_name) else p_name || '  ' end as source, p_brand as target from part)
select sha256(lower({SQUEEZE.format('source')})) as id, count(*) as n, count(distinct lower({SQUEEZE.format('target')})) as others from pairs group by lower({SQUEEZE.format('source')}) having count(distinct lower({SQUEEZE.format('target')})) > 1""")
def inconsistencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, here names of parts in unlike case and spacing, that have more than one target."""
    source = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("  ")))
    pairs = table(spark, sf_dir, "part").select(source.alias("source"), F.col("p_brand").alias("target"))
    return memory.inconsistencies(pairs, "source", "target").select(F.sha2(F.col("source").cast("binary"), 256).alias("id"), "n", "others")


@query("a43_consistency", """
with s as (select p_partkey as id, p_type as source, p_brand as target from part), p as (select distinct source, target from s)
select id, (select count(*) from p where p.source = s.source) > 1 as many_targets, (select count(*) from p where p.target = s.target) > 1 as many_sources from s""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("source"), F.col("p_brand").alias("target"))
    return memory.consistency(part, "source", "target").select("id", "many_targets", "many_sources")


@query("a30_d16_term_extraction", r"""
with w as (select doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents),
grams as (select lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as term from w where lang is not null),
counted as (select lang, term, count(*) as freq, len(string_split(term, ' ')) as n from grams group by all having count(*) >= 2),
inner_runs as (select lang, unnest([array_to_string(string_split(term, ' ')[1 : n - 1], ' '), array_to_string(string_split(term, ' ')[2 : n], ' ')]) as term, freq from counted where n > 1),
covered as (select lang, term, max(freq) as f from inner_runs group by all),
kept as (select c.* from counted c left join covered v on v.lang = c.lang and v.term = c.term where v.f is null or v.f < c.freq)
select lang, term, freq, rank from (select *, row_number() over (partition by lang order by freq * (1 + 0.5 * (n - 1)) desc, term) as rank from kept) where rank <= 50""")
def term_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty first word runs of each language (a report): counted in all documents."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and text is not null").select("lang", T.words(F.lower("text")).alias("w"))
    return memory.extract_terms(docs, F.col("w"), ["lang"]).select("lang", "term", "freq", "rank")


@query("a31_dice", rf"""
with {PAIRS}, w as (select row_number() over () as key, list_distinct(regexp_extract_all(lower(source), '[\p{{L}}\p{{N}}_]+')) as s, list_distinct(regexp_extract_all(lower(target), '[\p{{L}}\p{{N}}_]+')) as t from pairs),
src as (select key, unnest(s) as s from w), tgt as (select key, unnest(t) as t from w), m as (select s, count(*) as m from src group by s), f as (select t, count(*) as f from tgt group by t),
c as (select s, t, count(*) as c from src join tgt using (key) group by all), scored as (select s, t, c, 2.0 * c / (m + f) as dice from c join m using (s) join f using (t))
select s, t, c, round(dice, 6)::double as dice from (select *, row_number() over (partition by s order by dice desc, c desc, t) as r from scored where dice >= 0.2) where r <= 3""")
def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur together in turns and their answers."""
    pairs = parallel(spark, sf_dir).select(F.struct("conv_id", "turn").alias("key"), T.words(F.lower("source")).alias("a"), T.words(F.lower("target")).alias("b"))
    return memory.dice(pairs, "a", "b").select("s", "t", "c", F.round("dice", 6).alias("dice"))


@query("s20_paragraphs", r"""
with p as (select doc_id, string_split_regex(coalesce(text, ''), '\n[ \t]*\n') as parts from documents)
select doc_id, n, length(parts[n + 1]) as chars from (select doc_id, parts, unnest(range(len(parts))) as n from p) where trim(parts[n + 1], chr(10) || ' ') <> ''""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs between blank lines."""
    from weftline.sources import plain

    return plain.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("n").cast("long").alias("n"), F.length("paragraph").cast("long").alias("chars"))


@query("f19_repeated_words", r"""
with told as (select doc_id, string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+') as parts from documents),
each_pair as (select doc_id, regexp_extract(parts[i], '(?:^|[^\pL\pN_])(\pL+)$', 1) as a, regexp_extract(parts[i + 1], '^(\pL+)(?:[^\pL\pN_]|$)', 1) as b
  from (select doc_id, parts, unnest(range(1, len(parts))) as i from told))
select d.doc_id, (select count(*) from each_pair e where e.doc_id = d.doc_id and a <> '' and a = b) as n from documents d""")
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand twice in a row."""
    return table(spark, sf_dir, "documents").select("doc_id", T.repeated_words(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


@query("f51_half_even", """
with told as (select l_orderkey as job, l_linenumber as line, l_partkey as part, l_suppkey as supplier, l_quantity as q, (l_extendedprice::decimal(12,2) * 100)::bigint * 125 as x from lineitem)
select job, line, part, supplier, q, (x // 1000 + case when x % 1000 > 500 or (x % 1000 = 500 and (x // 1000) % 2 = 1) then 1 else 0 end) / 100.0::double as half_even from told""")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents rounded to the even one at a half, in decimals."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("q"), F.bround(price * F.lit("0.125").cast("decimal(4,3)"), 2).cast("double").alias("half_even"))
