"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, decontam, interpolation, licenses, linededup, pieces, quality, resample, secrets, simhash, toxicity, warc, whitening
from weftline.llm.common import table, written

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score_texts(docs, model, ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    messages = written(chat.turns_as_trees(rows.unionByName(extra)))
    formatted = chat.format_paths(messages, chat.chosen_paths(messages))
    read = formatted.select(chat.conversation(F.col("path")).cast("long").alias("conv_id"), "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="n_removed")
    return done.select("doc_id", "n_removed", "text")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("found", lambda s: s["rank"].isin(kinds))
    count = lambda rank: F.size(of([rank])).cast("long").alias(f"n_{secrets.KINDS[rank]}")
    base, digest = list(range(secrets.STRONG)), F.sha2(secrets.told(of(list(range(secrets.STRONG)))).cast("binary"), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), secrets.told(F.col("found")).alias("spans"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_quality_rules, op4_sentencepiece, op5_lm_scoring, op6_decontamination, op7_simhash, op8_chat_formatting, op9_warc, op10_line_dedup, op11_secret_scan, op12_importance_resampling, op13_whitening)}

def _secret_sql() -> str:
    """The same patterns, which mean the same to both engines; places by running sums, links by window frames."""
    one = "select r, {rank} as rank, unnest(range(length(text) + 1)) as i, unnest(regexp_extract_all(text, '{p}')) as m, unnest(string_split_regex(text, '{p}')) as gap from t where regexp_matches(text, '{p}')"
    patterns = [*secrets.PATTERNS.values(), secrets.BREAK]
    found = " union all ".join(f"select * from ({one.format(rank=i, p=p.replace(chr(39), chr(39) * 2))}) where m is not null" for i, p in enumerate(patterns))
    value = secrets.PATTERNS["assign"].replace("'", "''")
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    told = "string_agg({kinds}[rank + 1] || ':' || s || ':' || e, ',' order by s, rank, e)".format(kinds=kinds)
    return rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as ({found}),
placed as (
  select r, rank, m, sum(length(gap) + length(m)) over (partition by r, rank order by i) as e from found
), held as (
  select r, rank, e, e - length(m) as s from placed
  where case when rank = 0 then length(regexp_extract(m, '{value}', 2)) >= 6
    when rank = 4 then regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[0-9]') else true end
), seen as (
  select *, max(case when rank < 3 then e end) over b as s0, min(case when rank < 3 then s end) over f as s1,
    max(case when rank < 6 and rank <> 4 then e end) over b as n0, min(case when rank < 6 and rank <> 4 then s end) over f as n1,
    sum(case when rank = 6 then 1 else 0 end) over (partition by r order by s, rank) as scope
  from held window b as (partition by r order by s, rank rows between unbounded preceding and 1 preceding),
    f as (partition by r order by s, rank rows between 1 following and unbounded following)
), apart as (
  select r, rank, s, e, scope from seen
  where rank < 6 and case when rank < 3 then true when rank = 4 then not (coalesce(n0 > s, false) or coalesce(n1 < e, false))
    else not (coalesce(s0 > s, false) or coalesce(s1 < e, false)) end
), met as (
  select *, max(case when rank in (0, 2, 4) then e end) over b as p0, min(case when rank in (0, 2, 4) then s end) over f as p1,
    max(case when rank in (1, 3, 5) then e end) over b as o0, min(case when rank in (1, 3, 5) then s end) over f as o1
  from apart window b as (partition by r, scope order by s, rank rows between unbounded preceding and 1 preceding),
    f as (partition by r, scope order by s, rank rows between 1 following and unbounded following)
), told as (
  select * from met where rank < 3
    or case when rank = 4 then coalesce(s - o0 <= 300, false) or coalesce(o1 - e <= 300, false)
      else coalesce(s - p0 <= 300, false) or coalesce(p1 - e <= 300, false) end
), summed as (
  select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    {told} filter (rank < 3) as base, {told} as spans from told group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join summed using (r)"""


ORACLE = {
    "op11_secret_scan": _secret_sql(),
    "op12_importance_resampling": r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as f from benchmark),
counted as (select r, f, count(*) as c from (select r, unnest(w) as f from docs) group by r, f),
sources as (select f, sum(c) as s, 0 as t from counted group by f union all select f, 0, count(*) from items group by f),
strings as (select f, sum(s) as s, sum(t) as t from sources group by f),
steps as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
hashed as (
  select f, s, t, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
  from strings, steps
), totals as (select sum(s)::double as all_s, sum(t)::double as all_t from strings),
gains as (
  select bucket, floor(1000 * ln((sum(t) + 1)::double * (all_s + 10000) / ((sum(s) + 1)::double * (all_t + 10000))))::bigint as gain
  from hashed, totals group by bucket, all_s, all_t
), weights as (select r, sum(c * gain)::bigint as weight from counted join hashed using (f) join gains using (bucket) group by r),
scored as (
  select r, doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from docs left join weights using (r)
), ordered as (
  select r, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as many from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= 10 * many // 100 then place end as rank from scored left join ordered using (r)""",
    "op8_chat_formatting": r"""
with all_rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), told as (
  select *, replace(replace(replace(text, '\', '\\'), '###', '#\#\#'), '</turn>', '<\/turn>') as body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '#\#\#'), '</turn>', '<\/turn>'), ':', '\:') as head
  from all_rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(length(head) + length(body) + 15) as bigint) as formatted_chars
from told group by conv_id""",
    "op9_warc": """
with told as (select page_id, coalesce(html, '') as payload from pages),
digests as (select page_id, strlen(payload) as payload_bytes, sha256(payload) as payload_digest from told),
firsts as (select *, min(page_id) over (partition by payload_digest) as first_id from digests)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from firsts""",
    "op10_line_dedup": r"""
with split as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
each_line as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as p from split),
worded as (
  select * from each_line where regexp_matches(line, '[^\x20\x09-\x0D]')
), runs as (
  select doc_id, line, p, count(*) over d as lines, lead(line, 1) over w as line2, lead(p, 1) over w as p2,
    lead(line, 2) over w as line3, lead(p, 2) over w as p3
  from worded window w as (partition by doc_id order by p), d as (partition by doc_id)
), windows as (
  select doc_id, p, p3 as q, '3' || chr(10) || line || chr(10) || line2 || chr(10) || line3 as content from runs where line3 is not null
  union all select doc_id, p, p2, '2' || chr(10) || line || chr(10) || line2 from runs where lines = 2 and line2 is not null
  union all select doc_id, p, p, '1' || chr(10) || line from runs where lines = 1
), later as (
  select doc_id, p, q from (select *, row_number() over (partition by content order by doc_id, p) as place from windows) where place > 1
), gone as (select distinct doc_id, unnest(range(p, q + 1)) as p from later),
kept as (
  select l.doc_id, count(g.p) as n_removed, string_agg(case when g.p is null then l.line end, chr(10) order by l.p) as text
  from each_line l left join gone g on l.doc_id = g.doc_id and l.p = g.p group by l.doc_id
)
select d.doc_id, coalesce(k.n_removed, 0) as n_removed, case when d.text is null then null else coalesce(k.text, '') end as text
from documents d left join kept k on d.doc_id = k.doc_id""",
    "op6_decontamination": r"""
with dwords as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iwords as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iwindows as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as content
  from (select item, w, unnest(range(greatest(1, len(w) - 9))) as i from iwords where len(w) > 0)
), sizes as (select distinct n from iwindows),
dwindows as (
  select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as content
  from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from dwords, sizes where len(w) >= n)
), hits as (select d.doc_id, d.i, d.n, b.item from dwindows d join iwindows b on d.n = b.n and d.content = b.content),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as digest from (select distinct doc_id, item from hits where item is not null) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  coalesce(i.digest, sha256('')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from dwords d left join words h on d.doc_id = h.doc_id left join items i on d.doc_id = i.doc_id""",
}
