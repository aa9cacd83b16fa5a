"""Queries whose operators need a UDF: similarity, tags, numbers, terms, alignment, reviews. The tests hold goldens for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import dates, language, messages, stems
from weftline.functions import text as T
from weftline.operators import alignment, glossary, memory, review
from weftline.plans.formats import spread
from weftline.plans.registry import query
from weftline.plans.texts import PAIRS, parallel
from weftline.sources import plain
from weftline.sources.tables import segments, table


def tagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and answers as tagged sources and targets: a code around the source, moved or lost in the target."""
    pairs = parallel(spark, sf_dir)
    source = F.concat(F.lit("⟦1⟧"), T.escape_brackets(F.col("source")), F.lit("⟦/1⟧⟦2/⟧"))
    target = F.concat(F.lit("⟦2/⟧⟦1⟧"), T.escape_brackets(F.col("target")), F.when(F.col("conv_id") % 3 == 0, "").otherwise("⟦/1⟧"))
    return pairs.select("conv_id", "turn", source.alias("source"), target.alias("target"))


@query("f06_f16_f17_d40_hard_checks")
def hard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of every turn against its answer."""
    codes = tagged_pairs(spark, sf_dir).select("conv_id", "turn", review.hard_checks(F.col("source"), F.col("target")).alias("codes"))
    return codes.select("conv_id", "turn", F.array_join(F.array_sort("codes"), ",").alias("codes"), review.blocked(F.col("codes")).alias("blocked"))


@query("f02_f03_normal_forms", "select doc_id, sha256(nfc_normalize(coalesce(text, ''))) as digest from documents")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts in normal form C."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(language.nfc(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("digest"))


@query("f11_d10_fuzzy_matches")
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the benchmark matched against each other: indel ratio of 60 or more, the three best of each."""
    items = table(spark, sf_dir, "benchmark").where("text is not null").select(F.explode(plain.sentences(F.col("text"))).alias("source")).distinct()
    queries, entries = items.select(F.col("source").alias("query"), "source"), items.select(F.col("source").alias("id"), "source")
    return review.fuzzy_matches(queries, entries, least=60.0)


@query("f14_word_diff")
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between turns, in words."""
    pairs = parallel(spark, sf_dir).select("conv_id", "turn", language.word_diff("source", "target").alias("d"))
    n = lambda op: F.size(F.filter("d", lambda x: x["op"] == op))
    return pairs.select("conv_id", "turn", n("equal").alias("kept"), n("delete").alias("deleted"), n("insert").alias("inserted"))


@query("f23_sentences")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every text; joined they give it back."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", plain.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n"), (F.array_join("s", "") == F.col("text")).alias("lossless"))


@query("f24_d81_icu_checks", """
select p_partkey as id, case p_partkey % 7 when 1 then 'icu_no_other,icu_argument_missing' when 2 then 'icu_argument_missing,icu_argument_added'
  when 3 then 'icu_argument_missing' when 4 then 'icu_unbalanced' when 5 then 'icu_type_changed' when 6 then 'icu_selectors_changed' else '' end as codes,
  'kind:select:full,other;count:plural:one,other' as shape from part""")
def icu_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ICU messages, a plural inside a select, against translations that lose or change a part of it."""
    n = F.col("p_partkey") % 7
    name = F.replace(F.col("p_name"), F.lit("'"), F.lit(""))
    plural = F.concat(F.lit("{count, plural, one {# "), name, F.lit("} other {# pieces of {name}, it''s '{x}'}}"))
    whole = lambda arg, full, rest: F.concat(F.lit(f"{{{arg}, select, "), F.lit(full), F.lit(" {"), plural, F.lit("} other {"), F.lit(rest), F.lit("}}"))
    source = whole("kind", "full", "none")
    target = (
        F.when(n == 0, source).when(n == 1, F.lit("{kind, select, full {{count, plural, one {# Teil}}} other {}}")).when(n == 2, F.concat(whole("kind", "full", "keine"), F.lit("{menge}")))
        .when(n == 3, plural).when(n == 4, F.concat(source, F.lit("}"))).when(n == 5, F.lit("{kind, select, full {{count, selectordinal, other {{name}}}} other {}}")).otherwise(whole("kind", "half", "keine"))
    )
    target = F.when(n == 2, F.replace(target, F.lit("{name}"), F.lit("Namen"))).otherwise(target)
    part = lambda s: F.concat_ws(":", s["name"], s["type"], F.array_join(s["selectors"], ","))
    told = spread(table(spark, sf_dir, "part"), F.col("p_partkey").alias("id")).select("id", messages.icu_check(source, target).alias("codes"), messages.icu_skeleton(source).alias("shape"))
    return told.select("id", F.array_join("codes", ",").alias("codes"), F.array_join(F.transform("shape", part), ";").alias("shape"))


@query("f24_protect_restore", """
select p_partkey as id, '⟦1/⟧' || p_name || ' ⟦⟦2⟧⟧⟦2/⟧# of ⟦3/⟧⟦4/⟧ & ' || p_type || ' ⟦5/⟧' as tagged,
  '{n, plural, =0 {|} other {|{0}|}}|%1$s' as codes, '{n, plural, =0 {' || p_name || ' ⟦2⟧} other {# of {0}}} & ' || p_type || ' %1$s' as restored, '' as unknown from part""")
def protect_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose frame and placeholders become codes, and come back; a code that the source hasn't gives nothing."""
    value = F.concat(F.lit("{n, plural, =0 {"), "p_name", F.lit(" ⟦2⟧} other {# of {0}}} & "), "p_type", F.lit(" %1$s"))
    told = spread(table(spark, sf_dir, "part"), F.col("p_partkey").alias("id")).select("id", messages.protected(value).alias("p"))
    back = told.select("id", "p.*", messages.restored("p.tagged", "p.codes").alias("restored"), messages.restored(F.concat("p.tagged", F.lit("⟦9/⟧")), "p.codes").alias("unknown"))
    return back.select("id", "tagged", F.array_join("codes", "|").alias("codes"), "restored", F.coalesce("unknown", F.lit("")).alias("unknown"))


@query("f27_r15_pseudo_translation")
def pseudo_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with marked vowels; what must stay stays."""
    rows = tagged_pairs(spark, sf_dir)
    told = rows.select("conv_id", "turn", "source", language.pseudo_translation("source").alias("target"))
    return told.select("conv_id", "turn", (T.codes(F.col("source")) == T.codes(F.col("target"))).alias("codes_kept"), F.sha2(F.col("target").cast("binary"), 256).alias("digest"))


@query("f59_d10_semantic_matches")
def semantic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest benchmark items of every item by hashed trigrams."""
    from weftline.operators import vectors

    items = table(spark, sf_dir, "benchmark").select("item_id", language.hashed_embedding("text").alias("v"))
    return vectors.nearest(items, items, "item_id", "v", 3).where("sim >= 0.6")


@query("d20_d21_j15_j16_glossary")
def glossary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms found in turns that their answers lack."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.lower("text"))).alias("w")).where(F.length("w") >= 4).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    kind = F.when(F.length("w") % 3 == 0, "do_not_translate").when(F.length("w") % 3 == 1, "mandatory").otherwise("preferred")
    terms = words.select(F.xxhash64("w").alias("term_id"), kind.alias("kind"), F.col("w").alias("source_term"), F.col("w").alias("target_term"), F.lit(False).alias("case_sensitive"))
    pairs = parallel(spark, sf_dir)
    hits = glossary.find_terms(pairs, terms, ["conv_id", "turn"]).join(pairs.select("conv_id", "turn", "target"), ["conv_id", "turn"])
    return glossary.violations(hits, ["conv_id", "turn"], "target", glossary.longest(terms, "target_term"))


@query("d30_a45_alignment")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of turns aligned with those of their answers."""
    sides = parallel(spark, sf_dir)
    told = alignment.align(sides, ["conv_id", "turn"], plain.sentences(F.col("source")), plain.sentences(F.col("target")))
    both = F.filter("beads", lambda b: (F.size(b["src"]) > 0) & (F.size(b["tgt"]) > 0))
    one = F.filter(both, lambda b: (F.size(b["src"]) == 1) & (F.size(b["tgt"]) == 1))
    low = F.filter(both, lambda b: b["confidence"] < 0.5)
    return told.select("conv_id", "turn", F.size(both).alias("pairs"), F.size(one).alias("one_to_one"), (F.size("beads") - F.size(both)).alias("unaligned"), F.size(low).alias("low"))


@query("d43_senate")
def senate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of several roles on the segments of a job, arbitrated."""
    s = segments(spark, sf_dir)
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    start = (F.col("part_id") % 40).cast("int")
    findings = s.select("job_id", pick(review.ROLES, F.col("vendor_id") % 4).alias("role"), pick(("accuracy", "terminology", "style", "fluency"), F.col("part_id") % 4).alias("dimension"), pick(review.SEVERITIES, F.col("words") % 4).alias("severity"), start.alias("start"), (start + 1 + F.col("words") % 9).alias("end"))
    told = review.senate(findings, ["job_id"])
    n = lambda what: F.coalesce(F.size(F.filter("verdicts", lambda v: v["outcome"] == what)), F.lit(0))
    return told.select("job_id", "roles", "outcome", n("confirmed").alias("confirmed"), n("discarded").alias("discarded"), n("verify").alias("to_verify"))


@query("d61_d41_d48_grading", """
with e as (select l_orderkey as id, coalesce(list_distinct(list(l_returnflag) filter (where l_linenumber <= 3)), []) as want, coalesce(list_distinct(list(l_returnflag) filter (where l_linenumber >= 3)), []) as have from lineitem group by 1),
told as (select *, len(list_intersect(want, have)) as hit, len(list_filter(have, lambda x: not list_contains(want, x))) as wrong from e)
select id, round(case when len(want) = 0 then case when wrong = 0 then 1.0 else 0.0 end else greatest(0.0, (hit - 0.5 * wrong) / len(want)) end::double, 6) as grade,
  (not list_contains(want, 'A') or list_contains(have, 'A')) and (not list_contains(want, 'R') or list_contains(have, 'R')) as terms_kept from told""")
def grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls graded by the errors found, and edits that lose a term."""
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_returnflag"))).alias("want"), F.collect_set(F.when(F.col("l_linenumber") >= 3, F.col("l_returnflag"))).alias("have"))
    kept = review.kept_terms(F.array_join("want", " "), F.array_join("have", " "), F.array(F.lit("A"), F.lit("R")))
    return e.select(F.col("l_orderkey").alias("id"), F.round(review.graded(F.col("want"), F.col("have")), 6).alias("grade"), kept.alias("terms_kept"))


@query("f08_f09_stem_matches", """
with words as (select distinct unnest(string_split(p_name, ' ')) as w from part), told as (select a.w as a, b.w as b, least(length(a.w), length(b.w)) as s, greatest(length(a.w), length(b.w)) as l from words a join words b on left(a.w, 3) = left(b.w, 3))
select a, b, a = b or (greatest(4, s - 1, l - 2) <= s and left(a, greatest(4, s - 1, l - 2)) = left(b, greatest(4, s - 1, l - 2))) as same from told""")
def stem_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that count as forms of one another."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct().withColumn("k", F.substring("a", 1, 3))
    both = words.join(words.withColumnRenamed("a", "b"), "k")
    return both.select("a", "b", T.loose_stem_match(F.col("a"), F.col("b")).alias("same"))


@query("f08_stems")
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of all distinct words of the documents, in their languages."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(T.found(F.lower("text"), r"[\p{L}\p{M}]+")).alias("word")).distinct()
    return words.select("lang", "word", stems.stemmed("word", "lang").alias("stem"))


@query("d21_forbidden_terms", "with " + PAIRS + r""",
words as (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from benchmark), terms as (select w from words where length(w) >= 5 group by w having count(*) >= 2),
toks as (select conv_id, turn, unnest(range(len(k))) as pos, unnest(k) as k from (select conv_id, turn, regexp_extract_all(lower(target), '[\p{L}\p{N}\x{300}-\x{36f}_]+(?:[''’][\p{L}\p{N}\x{300}-\x{36f}_]+)*') as k from pairs)),
alike as (select distinct k, w from (select distinct k from toks) join terms on left(k, 4) = left(w, 4) where k = w or (greatest(4, least(length(k), length(w)) - 1, greatest(length(k), length(w)) - 2) <= least(length(k), length(w)) and left(k, greatest(4, least(length(k), length(w)) - 1, greatest(length(k), length(w)) - 2)) = left(w, greatest(4, least(length(k), length(w)) - 1, greatest(length(k), length(w)) - 2)))),
best as (select conv_id, turn, pos, min(w) as term_id from toks join alike using (k) group by conv_id, turn, pos)
select distinct conv_id, turn, term_id from best""")
def forbidden_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a forbidden word, in any form."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.lower("text"))).alias("w")).where(F.length("w") >= 5).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    terms = words.select(F.col("w").alias("term_id"), F.lit("forbidden").alias("kind"), F.col("w").alias("source_term"), F.col("w").alias("target_term"), F.lit(False).alias("case_sensitive"))
    return glossary.forbidden(parallel(spark, sf_dir), terms, ["conv_id", "turn"], "target")


@query("f15_find_replace", r"""
select doc_id, len(regexp_extract_all(coalesce(text, ''), '\b[Tt]he\b')) as found, sha256(regexp_replace(coalesce(text, ''), '\b[Tt]he\b', 'THE', 'g')) as digest from documents where lang = 'en'""")
def find_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words found and replaced."""
    docs, x = table(spark, sf_dir, "documents").where("lang = 'en'"), F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.regexp_count(x, F.lit(r"\b[Tt]he\b")).cast("long").alias("found"), F.sha2(F.regexp_replace(x, r"\b[Tt]he\b", "THE").cast("binary"), 256).alias("digest"))


#: Phrases and what they mean in SQL, from "now"; isodow counts from Monday, so Friday is 5.
PHRASES = {
    "by Friday": "now + ((5 - isodow(now) + 7) % 7)::integer", "in 3 days": "now + 3", "tomorrow": "now + 1",
    "on 24.12.": "make_date(year(now) + case when now > make_date(year(now), 12, 24) then 1 else 0 end, 12, 24)",
    "within 2 weeks": "now + 14", "soon": "null", "next week, please": "now + ((5 - isodow(now) + 7) % 7)::integer + 7",
    "end of the week": "now + ((5 - isodow(now) + 7) % 7)::integer", "do ponedeljka": "now + ((1 - isodow(now) + 7) % 7)::integer",
    "before Sunday": "now + ((7 - isodow(now) + 7) % 7)::integer", "za 10 dana": "now + 10", "until 31.02.": "null", "2026-10-20": "date '2026-10-20'",
    "do petka": "now + ((5 - isodow(now) + 7) % 7)::integer", "on 1.3.2031": "date '2031-03-01'", "TODAY": "now",
}


@query("f47_relative_dates", f"""
with d as (select o_orderkey as id, o_orderdate::date as now from orders)
select id, strftime(case id % {len(PHRASES)} {' '.join(f"when {i} then {x}" for i, x in enumerate(PHRASES.values()))} end, '%Y-%m-%d') as day from d""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that phrases mean, from each job's date."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("o_orderkey") % len(PHRASES) + 1).cast("int"))
    day = dates.relative_date(phrase, F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("s45_splice", "select doc_id, sha256(coalesce(text, '')) as digest from documents where coalesce(text, '') <> ''")
def splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences spliced by their places give each text back."""
    parts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(plain.sentences(F.col("text"))).alias("at", "piece"))
    return plain.spliced(parts, "doc_id", "at", "piece").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("d22_j09_term_versions", """
with rows as (select p_brand as term, p_partkey as v, p_size as s from part)
select term, v as valid_from, lead(v) over (partition by term order by v) as valid_to from rows""")
def term_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change closes the version before it."""
    from weftline.operators import relational as ops

    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("v"))
    return ops.neighbours(rows, ["term"], [F.col("v")], ["v"]).select("term", F.col("v").alias("valid_from"), F.col("next_v").alias("valid_to"))


@query("d15_term_consistency")
def term_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory entries that break the glossary: violations by term."""
    return glossary_check(spark, sf_dir).groupBy("term_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("d12_d13_concordance", r"""
select doc_id, seq, line from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as seq from documents) where line ilike '%the of%'""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a phrase."""
    lines = memory.lines_of(table(spark, sf_dir, "documents"))
    return lines.where(F.col("line").ilike("%the of%")).select("doc_id", F.col("seq").cast("long").alias("seq"), "line")


PHRASES_ASKED = ["onde mente", "reing", "Änderung der"]


def _grams(x: str) -> str:
    """A text's trigrams in order, in SQL."""
    return f"flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


#: The best stretch of every text against every phrase, by all stretches that begin and end with a common trigram.
EXTENTS = f"""phrases as (select phrase, list_distinct({_grams('phrase')}) as q from (select unnest({PHRASES_ASKED}) as phrase)),
told as (select key, side, phrase, q, g, list_filter(range(1, len(g) + 1), lambda i: list_contains(q, g[i])) as hits from (select key, side, {_grams('text')} as g from texts), phrases),
stretches as (select key, side, phrase, q, g, a, unnest(list_filter(hits, lambda b: b >= a)) as b from (select key, side, phrase, q, g, hits, unnest(hits) as a from told)),
measured as (select key, side, phrase, max(len(list_intersect(list_distinct(g[a:b]), q)) / (len(q) + len(list_distinct(g[a:b])) - len(list_intersect(list_distinct(g[a:b]), q)))) as similarity from stretches group by key, side, phrase)"""


@query("f13_word_similarity", f"""
with texts as (select item_id as key, 1 as side, text from benchmark where text is not null), {EXTENTS}
select key as item_id, phrase, round(similarity, 9) as similarity from measured where similarity >= 0.4""")
def word_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with a stretch that is like a phrase."""
    found = memory.word_similar(table(spark, sf_dir, "benchmark"), "text", PHRASES_ASKED, 0.4)
    return found.select("item_id", "phrase", F.round("similarity", 9).alias("similarity"))


@query("d12_f13_ranked_concordance", f"""
with {PAIRS.replace('pairs as', 'pairs as materialized')},
held as (select conv_id * 1000000 + turn as key, conv_id, turn, source, target from pairs where contains(lower(source), 'reing') or contains(lower(target), 'reing')),
texts as (select key, 1 as side, source as text from held union all select key, 2, target from held), {EXTENTS},
best as (select key, max(similarity) as similarity from measured where phrase = 'reing' group by key)
select conv_id, turn, round(coalesce(similarity, 0), 9) as similarity from held left join best using (key) order by coalesce(similarity, 0) desc, conv_id, turn limit 25""")
def ranked_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold a phrase in either language, the most alike first."""
    found = memory.concordance(parallel(spark, sf_dir), "reing", ["source", "target"], [F.col("conv_id"), F.col("turn")])
    return found.select("conv_id", "turn", F.round("similarity", 9).alias("similarity"))
