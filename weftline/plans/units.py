"""Units and their codes, numbers that match, inputs of audits, replayed logs, lists without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import language
from weftline.functions import text as T
from weftline.operators import relational as ops
from weftline.operators import units
from weftline.plans.formats import files, spread
from weftline.plans.language import tagged_pairs
from weftline.plans.registry import query, shown
from weftline.plans.texts import PAIRS
from weftline.sources import bilingual
from weftline.sources import documents as D
from weftline.sources.tables import USAGE, table, usage

SPACE = r"[ \t\n\x0B\f\r]"


@query("s46_unit_build", rf"""
select doc_id, length(regexp_extract(text, '^{SPACE}*')) as leading, length(regexp_extract(text, '{SPACE}*$')) as trailing, sha256(text) as digest, 1 as fitted
from documents where text is not null and regexp_matches(text, '[^ \t\n\x0B\f\r]')""")
def unit_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as units: white space around the segments kept apart, joined again, and fitted to a target of one segment."""
    told = table(spark, sf_dir, "documents").select("doc_id", units.built(F.col("text")).alias("u"), units.fitted(F.col("text"), F.lit(1)).alias("one")).where("u is not null")
    return told.select("doc_id", F.length("u.leading").alias("leading"), F.length(F.element_at("u.segments", -1)["trailing"]).alias("trailing"), F.sha2(units.joined(F.col("u")).cast("binary"), 256).alias("digest"), F.size("one.segments").alias("fitted"))


@query("s46_f06_code_guard", f"""
with {PAIRS} select conv_id, turn, case when conv_id % 3 = 0 then 'tag_unbalanced' end as refused from pairs""")
def code_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose codes may not be written back."""
    return tagged_pairs(spark, sf_dir).select("conv_id", "turn", units.refused(F.col("source"), F.col("target")).alias("refused"))


@query("j17_f17_number_matching", """
select p_partkey as id, case p_partkey % 3 when 0 then 0 else 1 end as missing, case p_partkey % 3 when 2 then 1 else 0 end as added from part""")
def number_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text and of its translation, matched by what they may mean: one lost, one changed, or none."""
    size, n = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    source = F.concat(size, F.lit(" und 1.000"))
    target = F.when(n == 0, F.concat(F.lit("1000, "), size)).when(n == 1, F.lit("1 000")).otherwise(F.concat(F.lit("1,5; "), size))
    return spread(table(spark, sf_dir, "part"), F.col("p_partkey").alias("id")).select("id", language.numbers_left(source, target).alias("x")).select("id", "x.*")


@query("f73_in_order", r"""
with w as (select conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from conversations where text is not null)
select conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:12], ' ') as first_words from w""")
def in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve different words of a turn, in the order in which they come."""
    words = F.array_distinct(T.words(F.lower("text")))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(F.slice(words, 1, 12), " ").alias("first_words"))


@query("t18_d93_replayed_evidence", f"""
with {USAGE}, log as (select *, strftime("at", '%Y-%m-%d') as day from usage)
select org_id, day, count(*) as changes, list(kind order by "at", id)[-1] as kind, (list(amount order by "at", id) filter (where kind = 'purchase'))[-1]::double as paid,
  sha256(string_agg(id || ':' || kind, ',' order by "at", id)) as history from log group by org_id, day""")
def replayed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log of each organisation's day, replayed: where it stands, and what it went through."""
    log = usage(spark, sf_dir).withColumn("day", F.date_format("at", "yyyy-MM-dd")).withColumn("paid", F.when(F.col("kind") == "purchase", F.col("amount")))
    told = ops.replayed(log, ["org_id", "day"], ["at", "id"], ["kind", "paid"], F.concat_ws(":", F.col("id").cast("string"), "kind"))
    return told.select("org_id", "day", "changes", "kind", shown("paid").alias("paid"), "history")


@query("s56_bilingual_tables", """
with p as (select p_partkey // 25 as file, p_partkey as k, p_name, p_type from part)
select file, p_name || ', "' || k || '"' || chr(10) || 'second line' as source, upper(p_type) || ';' as target from p""")
def bilingual_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of twenty columns with a separator in a quoted heading, and cells with quotes and line breaks."""
    from weftline.plans.formats import blocks

    head = '"Notes; more";' + ";".join(f"c{i}" for i in range(17)) + ";Source text;Translation\r\n"
    row = F.concat(F.lit("x" + ";" * 18 + '"'), "p_name", F.lit(', ""'), "p_partkey", F.lit('""\nsecond line";"'), F.upper("p_type"), F.lit(';"'))
    return bilingual.table_pairs(blocks(spark, sf_dir, row, "\ufeff" + head, "\r\n", "\r\n"), ["file"], "text").select("file", "source", "target")


@query("s56_d30_document_pairs", """
select p_partkey // 25 as file, 'Part ' || p_partkey || ' is a ' || p_name || '.' as source, upper('Part ' || p_partkey || ' is a ' || p_name || '.') as target, 0 as extra from part""")
def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of the same sentences, in two hands: every sentence finds its own."""
    from weftline.plans.formats import blocks

    line = F.concat(F.lit("Part "), "p_partkey", F.lit(" is a "), "p_name", F.lit("."))
    sides = blocks(spark, sf_dir, line, "", "", " ").select("file", F.col("text").alias("a"), F.upper("text").alias("b"))
    return bilingual.document_pairs(sides, ["file"], "a", "b").select("file", "source", "target", "extra")


@query("s56_s27_s50_auditor_inputs", """
with p as (select p_brand as brand, p_name as name, p_type as type, cast(substr(p_brand, 7) as integer) % 3 as k from part)
select brand, 'a; ' || name as source, upper(name) as target from p where k = 0
union all select brand, name || ' & ⟦1⟧more⟦/1⟧', '' from p where k = 1 union all select brand, type, lower(type) from p where k = 1
union all select brand, name || '⟦2/⟧', upper(name) from p where k = 2 union all select brand, name || '⟦2/⟧', lower(name) from p where k = 2""")
def auditor_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilingual tables by their headings, XLIFF with several segments a unit, and memories with several variants a language."""
    name, kind = F.col("p_name"), F.col("p_type")
    row = F.concat(F.col("p_partkey").cast("string"), F.lit(';"a; '), name, F.lit('";'), F.upper(name))
    unit = F.concat(F.lit('<unit id="'), F.col("p_partkey").cast("string"), F.lit('"><segment id="a"><source>'), name, F.lit(' &amp; <pc id="1">more</pc></source></segment><segment><source>'), kind, F.lit("</source><target>"), F.lower(kind), F.lit("</target></segment></unit>"))
    variant = lambda lang, x: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), x, F.lit("</seg></tuv>"))
    memory = F.concat(F.lit("<tu>"), variant("en-GB", F.concat(name, F.lit('<ph x="2"/>'))), variant("de", F.upper(name)), variant("de-AT", F.lower(name)), variant("fr", name), F.lit("</tu>"))
    forms = (("table", row, "ID;Source text;Translation\n", ""), ("xliff", unit, '<xliff version="2.0"><file id="f">', "</file></xliff>"), ("memory", memory, '<tmx version="1.4"><body>', "</body></tmx>"))
    number = F.substring("brand", 7, 9).cast("int") % 3
    all_files = None
    for k, (form, entry, head, tail) in enumerate(forms):
        own = files(spark, sf_dir, entry, head=head, tail=tail).where(number == k).select("brand", F.lit(form).alias("form"), "text")
        all_files = own if all_files is None else all_files.unionByName(own)
    return bilingual.read(all_files, ["brand"], "form", "text", "en", "de").select("brand", "source", "target")
