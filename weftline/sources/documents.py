"""Document and catalogue formats as Spark expressions over whole-file texts, or through Spark's own sources.

A reader takes a frame with a text column and gives one row a unit. Lines, cues, entries and elements are cut out by
splits and regular expressions inside the plan, so that columns are pruned and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import structured

# What the bytes 0x80 to 0x9F stand for in Windows-1252, where they stand for something.
CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of whole files; any store that Spark reads will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", decoded(F.col("content")).alias("text"))


def decoded(data: Column) -> Column:
    """Bytes as text: by a mark at the start, else as UTF-8 if they are, else as Windows-1252."""
    head = F.hex(F.substring(data, 1, 3))
    utf16 = head.startswith("FFFE") | head.startswith("FEFF")
    western = F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, CP1252)), "".join(CP1252.values()))
    plain = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(western)
    return F.when(utf16, F.decode(data, "UTF-16")).when(head == "EFBBBF", F.decode(F.substring(data, 4, 2**31 - 1), "UTF-8")).otherwise(plain)


def _pairs(text: Column, pattern: str, names: Sequence[str]) -> Column:
    """The groups of all matches, as an array of structs."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*groups)


def _units(df: DataFrame, keep: Sequence[str], units: Column) -> DataFrame:
    return df.select(*keep, F.posexplode(units).alias("n", "_u")).select(*keep, "n", "_u.*")


def _unescaped(x: Column) -> Column:
    r"""Backslash escapes of strings: \n, \t, \" and \\ ."""
    guarded = F.replace(x, F.lit("\\\\"), F.lit("\u0001"))
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"')):
        guarded = F.replace(guarded, F.lit(a), F.lit(b))
    return F.replace(guarded, F.lit("\u0001"), F.lit("\\"))


def escaped(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def properties(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, key, value) of key=value or key: value lines; # and ! begin comments, a last backslash joins the next line."""
    joined = F.regexp_replace(text, r"\\\r?\n[ \t]*", "")
    return _units(df, keep, _pairs(joined, r"(?m)^[ \t]*([^\s#!=:][^=:\r\n]*?)[ \t]*[=:][ \t]*([^\r\n]*)$", ["key", "value"]))


def apple_strings(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, key, value) of "key" = "value"; entries, comments aside."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    found = _units(df, keep, _pairs(bare, r'"((?:[^"\\]|\\.)*+)"\s*=\s*"((?:[^"\\]|\\.)*+)"\s*;', ["key", "value"]))
    return found.withColumns({c: _unescaped(F.col(c)) for c in ("key", "value")})


def gettext(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, context, source, plural, target, fuzzy) of gettext entries; the header (empty source) is left out."""
    entries = df.select(*keep, F.posexplode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n")).alias("n", "_e"))

    def part(name: str) -> Column:
        lines = F.regexp_extract("_e", rf'(?m)^{name} ((?:"(?:[^"\\]|\\.)*+"\s*)++)', 1)
        return _unescaped(F.array_join(F.regexp_extract_all(lines, F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1)), ""))

    told = entries.select(*keep, "n", part("msgctxt").alias("context"), part("msgid").alias("source"), part("msgid_plural").alias("plural"), F.coalesce(F.nullif(part(r"msgstr"), F.lit("")), part(r"msgstr\[0\]")).alias("target"), F.col("_e").rlike(r"(?m)^#,.*\bfuzzy\b").alias("fuzzy"))
    return told.where("source != ''")


def subtitles(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, start, end, line) of SRT and WebVTT cues; times in seconds."""
    cues = df.select(*keep, F.posexplode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n+")).alias("n", "_c"))
    time = r"(?:(\d+):)?(\d\d):(\d\d)[.,](\d{3})"
    pattern = rf"(?s)(?:^|\n){time} --> {time}[^\n]*\n?(.*)$"
    group = lambda i: F.regexp_extract("_c", pattern, i)
    seconds = lambda i: F.coalesce(F.nullif(group(i), F.lit("")).cast("int"), F.lit(0)) * 3600 + group(i + 1).cast("int") * 60 + group(i + 2).cast("int") + group(i + 3).cast("int") / 1000
    return cues.where(F.col("_c").rlike(pattern)).select(*keep, "n", seconds(1).alias("start"), seconds(5).alias("end"), F.rtrim(group(9)).alias("line"))


def dialogues(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, start, end, line) of ASS dialogue lines: the tenth field is the text, with override blocks taken out."""
    found = _units(df, keep, _pairs(F.col(text), r"(?m)^Dialogue:\s*[^,]*,([^,]*),([^,]*),(?:[^,]*,){6}([^\r\n]*)$", ["start", "end", "line"]))
    return found.withColumn("line", F.replace(F.regexp_replace("line", r"\{[^}]*\}", ""), F.lit("\\N"), F.lit("\n")))


def flat_json(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, key, value) of every text, number and truth value in a JSON file, keys and indexes joined by points."""
    return _dotted(structured.read(df, keep, text, "json values"), keep)


def yaml_scalars(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, key, value) of every text in a YAML file, keys and indexes joined by points."""
    return _dotted(structured.read(df, keep, text, "yaml"), keep)


def _dotted(found: DataFrame, keep: Sequence[str]) -> DataFrame:
    key = F.replace(F.substr("pointer", F.lit(2)), F.lit("/"), F.lit("."))
    return found.select(*keep, F.replace(F.replace(key, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("key"), "value")


ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def unescape_markup(x: Column) -> Column:
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return x


def escape_markup(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


INLINE = "a|abbr|b|bdi|bdo|br|cite|code|em|font|i|img|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr"


def html_blocks(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, block): runs of text between block tags; scripts, styles and comments are out, inline tags too."""
    bare = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>|<!doctype[^>]*>", "\u0001")
    inline = F.regexp_replace(bare, rf"(?i)</?(?:{INLINE})\b[^>]*>", "")
    parts = F.split(F.regexp_replace(inline, "<[^>]*>", "\u0001"), "\u0001", -1)
    blocks = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(unescape_markup(p), r"\s+", " "))), lambda p: p != "")
    return df.select(*keep, F.posexplode(blocks).alias("n", "block"))


def markdown_blocks(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, kind, block): headings, list items, table rows, quotes and paragraphs; front matter and code are out."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", ""), r"(?ms)^(```|~~~).*?^\1[^\n]*$", "")
    apart = F.regexp_replace(bare, r"(?m)^(#{1,6} [^\n]*)$", "$1\n")
    lines = F.split(apart, r"\n(?=[ \t]*(?:#{1,6} |[-*+] |\d+[.)] |> |\|))|\n[ \t]*\n", -1)
    parts = df.select(*keep, F.posexplode(lines).alias("n", "_b")).where(F.trim("_b", F.lit(" \n\t")) != "")
    b = F.col("_b")
    kind = F.when(b.rlike(r"^\s*#{1,6} "), "heading").when(b.rlike(r"^\s*(?:[-*+]|\d+[.)]) "), "item").when(b.rlike(r"^\s*\|"), "row").when(b.rlike(r"^\s*> "), "quote").otherwise("paragraph")
    return parts.select(*keep, "n", kind.alias("kind"), F.trim(F.regexp_replace(b, r"^\s*(?:#{1,6}|[-*+]|\d+[.)]|>) ", ""), F.lit(" \n\t")).alias("block"))


def xliff(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, id, segment, source, target) of XLIFF 1.2 trans-units and of every segment of 2.x units; inline elements
    become codes, units that are not to be translated are left out."""
    from weftline.sources import xliff as files

    return files.read(df, keep, text).where("translate").drop("translate")


def named_elements(df: DataFrame, keep: Sequence[str], text: str, element: str, name: str = "name", value: str | None = None) -> DataFrame:
    """(keep, n, key, value) of elements with a name: Android strings (string), resx data (data, value in ``value``)."""
    found = _units(df, keep, _pairs(F.col(text), rf'(?s)<{element}(?=[\s>])[^>]*?\b{name}="([^"]*)"[^>]*>(.*?)</{element}>', ["key", "value"]))
    inner = F.regexp_extract("value", rf"(?s)<{value}\b[^>]*>(.*?)</{value}>", 1) if value else F.col("value")
    return found.withColumn("value", unescape_markup(inner))


def tbx(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, lang, term) of TBX entries, versions 2 (termEntry, langSet) and 3 (conceptEntry, langSec)."""
    entries = _units(df, keep, _pairs(F.col(text), r"(?s)<(?:termEntry|conceptEntry)\b[^>]*>(.*?)</(?:termEntry|conceptEntry)>", ["body"]))
    sections = _pairs(F.col("body"), r'(?s)<(?:langSet|langSec)\b[^>]*?xml:lang="([^"]*)"[^>]*>(.*?)</(?:langSet|langSec)>', ["lang", "section"])
    each = entries.select(*keep, "n", F.explode(sections).alias("s")).select(*keep, "n", "s.*")
    return each.select(*keep, "n", "lang", F.explode(F.regexp_extract_all("section", F.lit(r"(?s)<term\b[^>]*>(.*?)</term>"), F.lit(1))).alias("term")).withColumn("term", unescape_markup(F.col("term")))


def plural_strings(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, key, category, value) of the plural forms in a property list."""
    entries = _units(df, keep, _pairs(F.col(text), r"(?s)<key>([^<]+)</key>\s*<dict>\s*<key>NSStringLocalizedFormatKey</key>(.*?)</dict>\s*</dict>", ["key", "body"]))
    forms = _pairs(F.col("body"), r"(?s)<key>(zero|one|two|few|many|other)</key>\s*<string>(.*?)</string>", ["category", "value"])
    return entries.select(*keep, "n", "key", F.explode(forms).alias("f")).select(*keep, "n", "key", F.col("f.category").alias("category"), unescape_markup(F.col("f.value")).alias("value"))


def catalogue(df: DataFrame, form: str, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, key, value) of a string catalogue in any of the forms of ``CATALOGUES``."""
    return CATALOGUES[form](df, keep, text).select(*keep, "key", "value")


def _entries(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    return gettext(df, keep, text).select(*keep, F.when(F.col("context") != "", F.concat_ws("\u0004", "context", "source")).otherwise(F.col("source")).alias("key"), F.col("target").alias("value"))


#: ARB and the JSON families are flat or nested JSON; ARB's @ keys describe others.
CATALOGUES = {
    "json": flat_json,
    "arb": lambda df, keep, text: flat_json(df, keep, text).where(~F.startswith("key", F.lit("@"))),
    "android": lambda df, keep, text: named_elements(df, keep, text, "string"),
    "resx": lambda df, keep, text: named_elements(df, keep, text, "data", value="value"),
    "strings": apple_strings,
    "properties": properties,
    "yaml": yaml_scalars,
    "gettext": _entries,
    "xliff": lambda df, keep, text: xliff(df, keep, text).select(*keep, F.when(F.col("segment") == "1", F.col("id")).otherwise(F.concat_ws("/", "id", "segment")).alias("key"), F.coalesce("target", "source").alias("value")),
}


def _tagged(seg: Column) -> Column:
    """The inline elements of a segment as codes: bpt and ept by i open and close one, ph and it by x stand alone; hi goes."""
    out = F.replace(F.replace(seg, F.lit("⟦"), F.lit("⟦⟦")), F.lit("⟧"), F.lit("⟧⟧"))
    for tag, name, form in (("bpt", "i", "⟦$1⟧"), ("ept", "i", "⟦/$1⟧"), ("ph", "x", "⟦$1/⟧"), ("it", "x", "⟦$1/⟧")):
        out = F.regexp_replace(out, rf'(?s)<{tag}\b[^>]*?\b{name}="(\w+)"[^>]*?(?:/>|>.*?</{tag}>)', form)
    return F.regexp_replace(out, r"</?hi\b[^>]*>", "")


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    """(unit, lang, text) a variant, through Spark's XML source: large memories are split by their units. Units in fewer
    than two languages are left out; inline elements become codes."""
    rows = spark.read.format("xml").option("rowTag", "tu").schema("tuv array<struct<`_xml:lang`:string,_lang:string,seg:string>>").load(path)
    told = rows.where(F.size("tuv") >= 2).withColumn("unit", F.sha2(F.to_json("tuv").cast("binary"), 256))
    return told.select("unit", F.explode("tuv").alias("v")).select("unit", F.coalesce(F.col("v")["_xml:lang"], F.col("v._lang")).alias("lang"), _tagged(F.col("v.seg")).alias("text"))


def tmx_units(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, variants (lang, text)) of memories that are whole texts in a column."""
    units = _units(df, keep, _pairs(F.col(text), r"(?s)<tu(?=[\s>])[^>]*>(.*?)</tu>", ["body"]))
    variants = _pairs(F.col("body"), r"""(?s)<tuv\b[^>]*?\b(?:xml:)?lang=["']([^"']*)["'][^>]*>.*?<seg>(.*?)</seg>""", ["lang", "seg"])
    return units.select(*keep, "n", F.transform(variants, lambda v: F.struct(v["lang"].alias("lang"), unescape_markup(_tagged(v["seg"])).alias("text"))).alias("variants"))


def memory_pairs(variants: DataFrame, source: str, target: str) -> DataFrame:
    """(unit, source, target) of the variants in two languages, by primary subtag: each of one with each of the other."""
    from weftline.functions.text import primary

    side = lambda lang, name: variants.where(primary(F.col("lang")) == lang).select("unit", F.col("text").alias(name)).where(F.col(name).isNotNull()).distinct()
    return side(source, "source").join(side(target, "target"), "unit")


def write_tmx(pairs: DataFrame, path: str, source: str, target: str) -> None:
    """A memory as XML, one file a partition. The writer knows no xml: attributes, so languages stand in ``lang``."""
    side = lambda lang, c: F.struct(F.lit(lang).alias("_lang"), F.col(c).alias("seg"))
    pairs.select(F.array(side(source, "source"), side(target, "target")).alias("tuv")).write.format("xml").option("rootTag", 'tmx version="1.4"').option("rowTag", "tu").save(path)


# Names that columns and kinds of a glossary go by.
HEADERS = {"source": ("source", "source_term", "term", "src"), "target": ("target", "target_term", "translation", "tgt"), "kind": ("kind", "type", "status"), "note": ("note", "comment", "definition")}
KINDS = {"dnt": "do_not_translate", "do not translate": "do_not_translate", "do_not_translate": "do_not_translate", "forbidden": "forbidden", "mandatory": "mandatory", "approved": "mandatory", "required": "mandatory", "preferred": "preferred"}


def read_glossary(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(source, target, kind, note, error) of a glossary table whose columns may have other names; bad rows carry an error."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    known = {c.strip().lower(): c for c in raw.columns}
    pick = lambda n: F.coalesce(*(F.trim(F.col(f"`{known[a]}`")) for a in HEADERS[n] if a in known), F.lit(None).cast("string"))
    said = F.lower(pick("kind"))
    kind = F.coalesce(*(F.when(said == a, b) for a, b in KINDS.items()), F.when(said.isNull() | (said == ""), "mandatory"))
    rows = raw.select(pick("source").alias("source"), pick("target").alias("target"), kind.alias("kind"), pick("note").alias("note"))
    missing = F.coalesce(F.col("source"), F.lit("")) == ""
    no_target = F.col("kind").isin("mandatory", "preferred") & (F.coalesce(F.col("target"), F.lit("")) == "")
    return rows.withColumn("error", F.when(missing, "no source").when(F.col("kind").isNull(), "unknown kind").when(no_target, "no target"))


def guarded_csv(df: DataFrame, path: str) -> None:
    """A CSV whose text cells no spreadsheet reads as formulas."""
    from weftline.functions.text import formula_guard

    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    df.select(*(formula_guard(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns)).write.option("header", True).csv(path)
