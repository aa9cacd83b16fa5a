"""Readers of document formats, checked by round trips: rows are written in a format and read back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.plans.texts import PAIRS
from weftline.sources import documents as D
from weftline.sources.tables import table


def spread(parts: DataFrame, file: Column) -> DataFrame:
    """Parts with the file they go to, dealt by it; the number of partitions is given, for what a reader has to do with a file
    doesn't show in its bytes, by which adaptive plans would join partitions."""
    number = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = parts.select("*", file)
    return named.repartition(number, named.columns[-1])


def files(spark: SparkSession, sf_dir: str, line: Column, sep: str = "\n", head: str = "", tail: str = "") -> DataFrame:
    """(brand, text): one file a brand, with an entry for each of its parts, in order."""
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))["line"]
    brands = spread(table(spark, sf_dir, "part"), F.col("p_brand").alias("brand")).groupBy("brand").agg(lines.alias("l"))
    return brands.select("brand", F.concat(F.lit(head), F.array_join("l", sep), F.lit(tail)).alias("text"))


BLOCK = 25


def blocks(spark: SparkSession, sf_dir: str, line: Column, head: str, tail: str, sep: str = "\n") -> DataFrame:
    """(file, text): one file for every ``BLOCK`` part numbers, so that files grow in number and not in size."""
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))["line"]
    parts = spread(table(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / BLOCK).alias("file")).groupBy("file").agg(lines.alias("l"))
    return parts.select("file", F.concat(F.lit(head), F.array_join("l", sep), F.lit(tail)).alias("text"))


PARTS = "select p_brand as brand, 'part.' || p_partkey as key, p_name || ' \"' || p_type || '\"' as value from part"


def key() -> Column:
    return F.concat(F.lit("part."), F.col("p_partkey"))


def value() -> Column:
    return F.concat(F.col("p_name"), F.lit(' "'), F.col("p_type"), F.lit('"'))


@query("s40_properties", PARTS)
def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = files(spark, sf_dir, F.concat(key(), F.lit(" = "), value()), head="# parts\n! more\n")
    return D.properties(text, ["brand"], "text").select("brand", "key", "value")


@query("s38_apple_strings", PARTS)
def apple_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = files(spark, sf_dir, F.concat(F.lit('"'), key(), F.lit('" = "'), D.escaped(value()), F.lit('";')), head="/* parts */\n")
    return D.apple_strings(text, ["brand"], "text").select("brand", "key", "value")


@query("s26_gettext", "select p_brand as brand, 'part.' || p_partkey as context, p_name as source, p_name || ' \"' || p_type || '\"' as target, p_size % 2 = 0 as fuzzy from part")
def gettext(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("p_size") % 2 == 0, "#, fuzzy\n").otherwise("")
    entry = F.concat(flag, F.lit('msgctxt "'), key(), F.lit('"\nmsgid ""\n"'), F.col("p_name"), F.lit('"\nmsgstr "'), D.escaped(value()), F.lit('"'))
    text = files(spark, sf_dir, entry, "\n\n", 'msgid ""\nmsgstr "Language: en"\n\n')
    return D.gettext(text, ["brand"], "text").select("brand", "context", "source", "target", "fuzzy")


@query("s34_s35_subtitles", "select p_brand as brand, p_partkey % 3600 + 0.25 as start, p_partkey % 3600 + 1.5 as end, p_name as line from part")
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("p_partkey") % 3600
    stamp = lambda s, ms: F.concat(F.lit("00:"), F.lpad((s / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(ms))
    cue = F.concat(F.col("p_partkey"), F.lit("\n"), stamp(at, ",250"), F.lit(" --> "), stamp(at + 1, ",500"), F.lit("\n"), F.col("p_name"))
    found = D.subtitles(files(spark, sf_dir, cue, "\n\n"), ["brand"], "text")
    # a cue that ends in the next hour is written with minute 60
    return found.select("brand", F.col("start"), (F.col("start") + 1.25).alias("end"), "line")


@query("s36_dialogues", "select p_brand as brand, p_partkey || ':00' as start, p_name || chr(10) || p_type as line from part")
def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("Dialogue: 0,"), F.col("p_partkey"), F.lit(":00,9:00,Main,,0,0,0,,{\\i1}"), F.col("p_name"), F.lit("\\N"), F.col("p_type"))
    return D.dialogues(files(spark, sf_dir, row, head="[Events]\n"), ["brand"], "text").select("brand", "start", "line")


@query("s25_s37_flat_json", "select c_custkey as id, 'name' as key, c_name as value from customer union all select c_custkey, 'place.nation', c_nationkey::varchar from customer union all select c_custkey, 'place.deep.segment', c_mktsegment from customer")
def flat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_mktsegment").alias("segment")).alias("deep"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_name").alias("name"), place.alias("place"))).alias("text"))
    return D.flat_json(rows, ["id"], "text")


@query("s42_yaml", PARTS.replace("'part.' || p_partkey", "'parts.part-' || p_partkey"))
def yaml_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("  part-"), F.col("p_partkey"), F.lit(": '"), value(), F.lit("'"))
    return D.yaml_scalars(files(spark, sf_dir, row, head="parts:\n"), ["brand"], "text").select("brand", "key", "value")


@query("s25_json_pointers", f"""
with p as (select p_partkey // {BLOCK} as file, p_partkey as k, p_name, p_type, row_number() over (partition by p_partkey // {BLOCK} order by p_partkey) - 1 as i from part),
told as (
  select file, k, i, '[{{"n/~": "' || p_name || '"}}, ' || k || ', ["' || case when k % 4 = 0 then upper(p_type) else p_type end || '", "\\u00e9 \\"q\\""]]' as line from p
)
select file, '/' || i || '/0/n~1~0' as pointer, p_name as value, digest from p join (select file, sha256('[' || string_agg(line, ',' || chr(10) order by k) || ']') as digest from told group by file) using (file)
union all select file, '/' || i || '/2/0', case when k % 4 = 0 then upper(p_type) else p_type end, digest from p join (select file, sha256('[' || string_agg(line, ',' || chr(10) order by k) || ']') as digest from told group by file) using (file)
union all select file, '/' || i || '/2/1', 'é "q"', digest from p join (select file, sha256('[' || string_agg(line, ',' || chr(10) order by k) || ']') as digest from told group by file) using (file)""")
def json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of arrays and objects: texts of some types in upper case are written back and read again, by their pointers."""
    row = F.concat(F.lit('[{"n/~": "'), "p_name", F.lit('"}, '), "p_partkey", F.lit(', ["'), "p_type", F.lit('", "\\u00e9 \\"q\\""]]'))
    text = blocks(spark, sf_dir, row, "[", "]", ",\n")
    return _changed(text, "json", r"^/\d+/2/0$", spark, sf_dir)


@query("s42_yaml_blocks", f"""
with p as (select p_partkey // {BLOCK} as file, p_partkey as k, p_name, p_type, row_number() over (partition by p_partkey // {BLOCK} order by p_partkey) - 1 as i from part),
told as (
  select file, k, '- name: ' || p_name || '  # said' || chr(10) || '  notes:' || chr(10) || '  - >-' || chr(10) || '    ' || case when k % 4 = 0 then upper(p_type) else p_type end || chr(10) || '  - [''it''''s'', {{"a/b": "x"}}, 7]' as line from p
), digests as (select file, sha256(string_agg(line, chr(10) order by k) || chr(10)) as digest from told group by file)
select file, '/' || i || '/name' as pointer, p_name as value, digest from p join digests using (file)
union all select file, '/' || i || '/notes/0', case when k % 4 = 0 then upper(p_type) else p_type end, digest from p join digests using (file)
union all select file, '/' || i || '/notes/1/0', 'it''s', digest from p join digests using (file)
union all select file, '/' || i || '/notes/1/1/a~1b', 'x', digest from p join digests using (file)""")
def yaml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of mappings with blocks, comments and flow collections: blocks of some are written back and read again."""
    row = F.concat(F.lit("- name: "), "p_name", F.lit("  # said\n  notes:\n  - >-\n    "), "p_type", F.lit("\n  - ['it''s', {\"a/b\": \"x\"}, 7]"))
    return _changed(blocks(spark, sf_dir, row, "", "\n"), "yaml", r"^/\d+/notes/0$", spark, sf_dir)


def _changed(text: DataFrame, form: str, where: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose texts at some pointers, of every fourth part, are put in upper case; read again, with the digest of the file."""
    from pyspark.sql import Window

    from weftline.sources import structured

    place = F.row_number().over(Window.partitionBy("file").orderBy("p_partkey")) - 1
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / BLOCK).alias("file"), "p_partkey").withColumn("i", place).where(F.col("p_partkey") % 4 == 0)
    own = structured.read(text, ["file"], "text", form).where(F.col("pointer").rlike(where)).withColumn("i", F.regexp_extract("pointer", r"^/(\d+)", 1).cast("int"))
    changes = own.join(parts, ["file", "i"], "left_semi").select("file", "pointer", F.upper("value").alias("value"))
    merged = structured.merge(text, ["file"], "text", form, changes).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    return structured.read(merged, ["file", "digest"], "text", form).select("file", "pointer", "value", "digest")


@query("s27_xliff", "select p_brand as brand, p_partkey::varchar as id, p_name || ' & <' || p_type || '>' as source, case when p_size % 2 = 0 then upper(p_name) end as target from part")
def xliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = D.escape_markup(F.concat(F.col("p_name"), F.lit(" & <"), F.col("p_type"), F.lit(">")))
    target = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<target>"), F.upper("p_name"), F.lit("</target>"))).otherwise("")
    unit = F.concat(F.lit('<trans-unit id="'), F.col("p_partkey"), F.lit('"><source>'), source, F.lit("</source>"), target, F.lit("</trans-unit>"))
    text = files(spark, sf_dir, unit, head='<xliff version="1.2"><file><body>', tail="</body></file></xliff>")
    return D.xliff(text, ["brand"], "text").select("brand", "id", "source", "target")


@query("s28_s41_named_elements", PARTS)
def named_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Android strings; resx data differ by the element's name."""
    row = F.concat(F.lit('<string name="'), key(), F.lit('">'), D.escape_markup(value()), F.lit("</string>"))
    return D.named_elements(files(spark, sf_dir, row, head="<resources>", tail="</resources>"), ["brand"], "text", "string").select("brand", "key", "value")


@query("s21_s22_csv", "select p_partkey as id, p_name || ',\"' || p_brand as name, p_type as kind from part")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV text and back, separators and quotes in the cells included."""
    rows = table(spark, sf_dir, "part").select(F.to_csv(F.struct(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(',"'), F.col("p_brand")).alias("name"), F.col("p_type").alias("kind")), {"escape": '"'}).alias("line"))
    return rows.select(F.from_csv("line", "id long, name string, kind string", {"escape": '"'}).alias("r")).select("r.*")


@query("s24_html_blocks", r"""
with bare as (select page_id, regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>|<!doctype[^>]*>', chr(1), 'g') as h from pages),
marked as (select page_id, regexp_replace(regexp_replace(h, '(?i)</?(?:a|abbr|b|bdi|bdo|br|cite|code|em|font|i|img|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr)\b[^>]*>', '', 'g'), '<[^>]*>', chr(1), 'g') as h from bare),
parts as (select page_id, unnest(string_split(h, chr(1))) as p from marked),
clean as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as b from parts)
select page_id, count(*) as blocks, sum(length(b))::bigint as chars from clean where b <> '' group by page_id""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of text of every page."""
    blocks = D.html_blocks(table(spark, sf_dir, "pages").where("html is not null"), ["page_id"], "html")
    return blocks.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("chars"))


@query("s23_s43_markdown_blocks")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every document by kind."""
    blocks = D.markdown_blocks(table(spark, sf_dir, "documents").where("text is not null"), ["doc_id"], "text")
    return blocks.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("s44_decoding", "select c_custkey as id, 'é€ ' || c_name as utf8, 'é€ ' || c_name as western from customer")
def decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of two encodings, told apart by their form."""
    name = F.col("c_name")
    utf8 = F.concat(F.lit("é€ "), name).cast("binary")
    western = F.concat(F.unhex(F.lit("E98020")), name.cast("binary"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), D.decoded(utf8).alias("utf8"), D.decoded(western).alias("western"))


@query("s55_tbx", "select p_brand as brand, 'en' as lang, p_name || ' & co' as term from part union all select p_brand, 'de', upper(p_name) from part")
def tbx(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = lambda lang, term: F.concat(F.lit(f'<langSec xml:lang="{lang}"><termSec><term>'), D.escape_markup(term), F.lit("</term></termSec></langSec>"))
    entry = F.concat(F.lit('<conceptEntry id="c">'), section("en", F.concat(F.col("p_name"), F.lit(" & co"))), section("de", F.upper("p_name")), F.lit("</conceptEntry>"))
    return D.tbx(files(spark, sf_dir, entry, head="<tbx><text><body>", tail="</body></text></tbx>"), ["brand"], "text").select("brand", "lang", "term")


@query("s39_plural_strings", "select p_brand as brand, 'part.' || p_partkey as key, 'one' as category, p_name as value from part union all select p_brand, 'part.' || p_partkey, 'other', p_type from part")
def plural_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda name, value: F.concat(F.lit(f"<key>{name}</key><string>"), value, F.lit("</string>"))
    entry = F.concat(F.lit("<key>"), key(), F.lit("</key><dict><key>NSStringLocalizedFormatKey</key><string>%#@n@</string><key>n</key><dict>"), form("one", F.col("p_name")), form("other", F.col("p_type")), F.lit("</dict></dict>"))
    return D.plural_strings(files(spark, sf_dir, entry, head="<plist><dict>", tail="</dict></plist>"), ["brand"], "text").select("brand", "key", "category", "value")


@query("s57_s37_catalogues", PARTS.replace("select p_brand as brand,", "select 'android' as form, p_brand as brand,") + " union all " + PARTS.replace("select p_brand as brand,", "select 'strings' as form, p_brand as brand,") + " union all " + PARTS.replace("select p_brand as brand,", "select 'properties' as form, p_brand as brand,"))
def catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue in several forms."""
    texts = {
        "android": files(spark, sf_dir, F.concat(F.lit('<string name="'), key(), F.lit('">'), D.escape_markup(value()), F.lit("</string>")), head="<resources>", tail="</resources>"),
        "strings": files(spark, sf_dir, F.concat(F.lit('"'), key(), F.lit('" = "'), D.escaped(value()), F.lit('";'))),
        "properties": files(spark, sf_dir, F.concat(key(), F.lit("="), value())),
    }
    found = [D.catalogue(text, form, ["brand"], "text").select(F.lit(form).alias("form"), "brand", "key", "value") for form, text in texts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


XLIFF_HEAD, XLIFF_TAIL = '<?xml version="1.0"?>\n<xliff version="2.0"><!-- <source>no</source> --><file id="f">\n', "\n</file></xliff>\n"


@query("s27_xliff_merge", f"""
with p as (
  select p_partkey // {BLOCK} as file, p_partkey as k, '<unit id="' || p_partkey || '"><segment><source>' || p_name || ' <pc id="1">' || p_type || '</pc> &#38; <ph id="2"/></source>' as head,
    case when p_partkey % 2 = 0 then '<target>alt &#38; <ph id="2"/></target>' else '' end as old, '</segment></unit>' as tail,
    case when p_partkey % 3 = 0 then '<target><pc id="1">' || upper(p_type) || '</pc> ' || p_name || ' <ph id="2"/> &amp; co</target>' end as new from part
)
select file, sha256('{XLIFF_HEAD}' || string_agg(head || old || tail, chr(10) order by k) || '{XLIFF_TAIL}') as same,
  sha256('{XLIFF_HEAD}' || string_agg(head || coalesce(new, old) || tail, chr(10) order by k) || '{XLIFF_TAIL}') as merged,
  count(new) as written, count(*) filter (k % 3 = 1) as refused from p group by file""")
def xliff_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations written into files: some replace a target, some are new, some are refused for a code of no source; and a
    merge of each file's own targets, which changes no byte."""
    from weftline.sources import xliff as X

    old = F.when(F.col("p_partkey") % 2 == 0, F.lit('<target>alt &#38; <ph id="2"/></target>')).otherwise("")
    unit = F.concat(F.lit('<unit id="'), F.col("p_partkey"), F.lit('"><segment><source>'), "p_name", F.lit(' <pc id="1">'), "p_type", F.lit('</pc> &#38; <ph id="2"/></source>'), old, F.lit("</segment></unit>"))
    text = blocks(spark, sf_dir, unit, XLIFF_HEAD, XLIFF_TAIL)
    good = F.concat(F.lit("⟦1⟧"), F.upper("p_type"), F.lit("⟦/1⟧ "), "p_name", F.lit(" ⟦2/⟧ & co"))
    k = F.col("p_partkey") % 3
    new = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / BLOCK).alias("file"), F.col("p_partkey").cast("string").alias("id"), F.lit("1").alias("segment"), F.when(k == 0, good).when(k == 1, F.concat(good, F.lit("⟦9/⟧"))).alias("target"))
    digest = lambda name: F.sha2(F.col("text").cast("binary"), 256).alias(name)
    merged = X.merge(text, ["file"], "text", new).select("file", digest("merged"), "written", "refused")
    same = X.merge(text, ["file"], "text", X.read(text, ["file"], "text")).select("file", digest("same"))
    return merged.join(same, "file")


@query("s27_xliff_export", f"""
with {PAIRS},
told as (select conv_id, turn, regexp_replace(source, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') as source, regexp_replace(target, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') as target from pairs)
select conv_id, turn::varchar as id, sha256('⟦1⟧' || replace(replace(source, '⟦', '⟦⟦'), '⟧', '⟧⟧') || '⟦/1⟧⟦2/⟧') as source,
  sha256('⟦2/⟧' || case when conv_id % 3 = 0 then '⟦1/⟧' else '⟦1⟧' end || replace(replace(target, '⟦', '⟦⟦'), '⟧', '⟧⟧') || case when conv_id % 3 = 0 then '' else '⟦/1⟧' end) as target from told""")
def xliff_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as XLIFF 2.1 files, one each, and read back; a code that lost its other end stands alone."""
    from weftline.plans.language import tagged_pairs
    from weftline.sources import xliff as X

    units = tagged_pairs(spark, sf_dir).select("conv_id", F.col("turn").alias("n"), F.col("turn").cast("string").alias("id"), "source", "target")
    back = X.read(X.export(units, ["conv_id"], "en", "de"), ["conv_id"], "text")
    return back.select("conv_id", "id", *(F.sha2(F.col(c).cast("binary"), 256).alias(c) for c in ("source", "target")))


MEMORY = f"""u as (select p_partkey as n, p_partkey // {BLOCK} as file, case when p_partkey % 3 = 0 then 'c' || p_partkey % 2 end as context, p_brand || ' ⟦1/⟧' as source, '⟦2⟧Art ' || p_size % 3 || '⟦/2⟧⟦1/⟧' as de, p_type as sr from part),
held as (select source, min(n) % 4 = 0 as reviewed, '⟦2⟧Art ' || case when min(n) % 4 = 0 then 1 else 2 end || '⟦/2⟧⟦1/⟧' as target from u group by source having min(n) % 2 = 0),
pairs as (select file, n, 0 as k, 'de-de' as lang, context, source, de as target from u where n % 7 > 0 and n % 11 > 0 and n % 13 > 0 union all select file, n, 1, 'sr-latn', context, source, sr from u where n % 7 > 0 and n % 11 > 0 and n % 5 = 0)"""


def _memory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(memory, units): some brands are held, reviewed or stale; units lack a language, have one only, or a blank target."""
    from weftline.operators import imports
    from weftline.sources import memories

    n = F.col("p_partkey")
    variant = lambda lang, seg: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), *seg, F.lit("</seg></tuv>"))
    de = F.when(n % 13 == 0, F.lit(' <ph x="2"/>')).otherwise(F.concat(F.lit("<hi>"), F.lit("Art "), F.col("p_size") % 3, F.lit('</hi><ph x="2">{x}</ph>')))
    first = F.when(n % 7 == 0, variant("fr", [F.lit("type")])).otherwise(variant("en-US", [F.col("p_brand"), F.lit(' <ph x="2"/>')]))
    both = F.concat(first, variant("de-DE", [de]), F.when(n % 5 == 0, variant("sr_Latn", [F.col("p_type")])).otherwise(""))
    context = F.when(n % 3 == 0, F.concat(F.lit('<prop type="x-context">c'), n % 2, F.lit("</prop>"))).otherwise("")
    unit = F.concat(F.lit("<tu>"), context, F.when(n % 11 == 0, first).otherwise(both), F.lit("</tu>"))
    text = blocks(spark, sf_dir, unit, '<tmx version="1.4"><header srclang="en"/><body>\n', "</body></tmx>")
    brands = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.lit(" ⟦1/⟧")).alias("source")).agg(F.min("p_partkey").alias("n")).where("n % 2 = 0")
    target = F.concat(F.lit("⟦2⟧Art "), F.when(F.col("n") % 4 == 0, 1).otherwise(2), F.lit("⟦/2⟧⟦1/⟧"))
    status = F.when(F.col("n") % 4 == 0, "approved").otherwise("stale")
    held = brands.select(F.lit("en-US").alias("source_lang"), F.lit("de-DE").alias("target_lang"), F.lit(None).cast("string").alias("context"), "source", target.alias("target"), F.lit("review").alias("origin"), status.alias("status"), F.lit(None).cast("string").alias("rights"))
    memory = imports.keyed(held).select(*(c.split()[0] for c in imports.ENTRY.split(", ")))
    return memory, memories.units(text, ["file"], "text")


@query("s50_d14_memory_import", f"""
with {MEMORY}, seen as (select *, lag(target) over (partition by lang, context, source order by n, k) as before from pairs),
acts as (select s.file, case when h.target is null and before is null then 'inserted' when case when reviewed then h.target else before end = s.target then 'unchanged' when reviewed then 'kept' else 'updated' end as action
  from seen s left join held h on h.source = s.source and lang = 'de-de' and context is null),
told as (select file, case when action in ('inserted', 'updated') then 'imported' else 'skipped' end as how from acts union all
  select file, case when n % 11 = 0 then 'skipped' else 'errors' end from u where n % 11 = 0 or n % 7 = 0 union all select file, 'skipped' from u where n % 13 = 0 and n % 7 > 0 and n % 11 > 0)
select file, count(*) filter (how = 'imported') as imported, count(*) filter (how = 'skipped') as skipped, count(*) filter (how = 'errors') as errors from told group by file""")
def memory_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each memory file brought: imported, skipped, with errors."""
    from weftline.operators import imports

    return imports.import_units(*_memory(spark, sf_dir), ["file"], ["file", "n"], "owner")[1]


@query("d14_s50_memory_after_import", f"""
with {MEMORY}, last as (select lang, context, source, arg_max(target, 2 * n + k) as target from pairs group by lang, context, source)
select coalesce(l.lang, 'de-de') as target_lang, l.context, coalesce(l.source, h.source) as source, case when h.source is not null and (reviewed or l.source is null) then h.target else l.target end as target,
  case when h.source is not null and (reviewed or l.source is null) then 'review' else 'import' end as origin
from last l full join held h on h.source = l.source and l.lang = 'de-de' and l.context is null""")
def memory_after_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory after an import: reviewed translations stay, stale ones are replaced."""
    from weftline.operators import imports

    memory, units = _memory(spark, sf_dir)
    changes, _ = imports.import_units(memory, units, ["file"], ["file", "n"], "owner")
    return imports.merged(memory, changes).select("target_lang", "context", "source", "target", "origin")


@query("s57_catalogue_forms", f"""
with f(form) as (values ('json'), ('json_nested'), ('i18next'), ('formatjs'), ('arb'), ('android'), ('strings'), ('stringsdict'), ('xcstrings'), ('yaml'), ('po'), ('pot'), ('xliff12'), ('xliff21'), ('csv')),
r as (select p_partkey // {BLOCK} as file, 'part.' || p_partkey as key, unnest(case when p_partkey % 4 = 0 then ['one', 'other'] else [null] end) as category, p_name || ' "' || p_type || chr(92) || chr(10) || '<' || p_partkey || ' & it''s>' as v from part)
select form, file, key, case when form = 'stringsdict' then coalesce(category, 'other') else category end as category,
  case when form in ('arb', 'xcstrings', 'yaml', 'csv') then 'de' end as lang, case when form = 'pot' then key else coalesce(category || ' ', '') || v end as value from r, f""")
def catalogue_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and plural families written in every form, the forms told by name and content, and read again."""
    from weftline.sources import catalogues as C

    n = F.col("p_partkey")
    category = F.explode(F.when(n % 4 == 0, F.array(F.lit("one"), F.lit("other"))).otherwise(F.array(F.lit(None).cast("string")))).alias("category")
    parts = spread(table(spark, sf_dir, "part"), F.floor(n / BLOCK).alias("file")).select("file", n.alias("n"), key().alias("key"), category, F.concat("p_name", F.lit(' "'), "p_type", F.lit("\\\n<"), n, F.lit(" & it's>")).alias("v"))
    rows = parts.select("file", "n", "key", "category", F.lit("de").alias("lang"), F.concat(F.coalesce(F.concat("category", F.lit(" ")), F.lit("")), "v").alias("value"))
    out = None
    for form, f in C.FORMS.items():
        files = C.render(rows, ["file"], form, ["n"]).where(C.detect(F.lit(f"app.{f.extension}"), F.col("text")) == form)
        found = C.read(files, ["file"], "text", form).withColumn("form", F.lit(form))
        out = found if out is None else out.unionByName(found)
    return out.select("form", "file", "key", "category", "lang", "value")
