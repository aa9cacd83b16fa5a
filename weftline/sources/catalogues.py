"""String catalogues of software: telling a file's form, reading it into one row model, and writing rows in any form.

A row is (key, category, lang, value): ``category`` is null for a plain text and a plural category for a form of a family, so a
family is the rows of one key; ``lang`` is null where a form holds one language and does not name it. Readers are expressions
over the text or the JSON, YAML and XLIFF readers; a writer puts the rows of one file together, in their order, and is the
inverse of its reader: what is read from a written file are the rows again, with the exceptions named at ``FORMS``.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions import text as T
from weftline.functions.batches import sliced
from weftline.sources import bilingual, structured, xliff
from weftline.sources import documents as D

# The plural categories.
CATEGORIES = ("zero", "one", "two", "few", "many", "other")
ROW = "key string, category string, lang string, value string"


class Row(NamedTuple):
    key: str
    category: str | None
    lang: str | None
    value: str


# ---- writers


def families(rows: Iterable[Row]) -> dict[str, str | dict[str, str]]:
    """Values by key, those of families by category."""
    out: dict[str, str | dict[str, str]] = {}
    for r in rows:
        if r.category is None:
            out[r.key] = r.value
        else:
            known = out.get(r.key)
            out[r.key] = {**(known if isinstance(known, dict) else {}), r.category: r.value}
    return out


def nested(rows: Iterable[Row]) -> dict:
    """Keys with points as objects in one another; a key whose place another text or family holds stays whole."""
    told = families(rows)
    root: dict = {}
    for key, value in told.items():
        parts = key.split(".")
        if not all(parts) or any(".".join(parts[:i]) in told for i in range(1, len(parts))):
            root[key] = value
            continue
        at = root
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = value
    return root


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, indent=2) + "\n"


def _suffixed(rows: list[Row]) -> str:
    return _json({r.key if r.category is None else f"{r.key}_{r.category}": r.value for r in rows})


def _arb(rows: list[Row]) -> str:
    lang = next((r.lang for r in rows if r.lang), "en")
    return _json({"@@locale": lang} | {r.key if r.category is None else f"{r.key}.{r.category}": r.value for r in rows})


def _xcstrings(rows: list[Row]) -> str:
    strings: dict = {}
    for r in rows:
        spoken = strings.setdefault(r.key, {"localizations": {}})["localizations"].setdefault(r.lang or "en", {})
        unit = {"stringUnit": {"state": "translated", "value": r.value}}
        if r.category is None:
            spoken.update(unit)
        else:
            spoken.setdefault("variations", {}).setdefault("plural", {})[r.category] = unit
    return _json({"sourceLanguage": next((r.lang for r in rows if r.lang), "en"), "strings": strings, "version": "1.0"})


def _yaml(rows: list[Row]) -> str:
    def lines(x: dict, depth: int) -> Iterable[str]:
        for k, v in x.items():
            head = "  " * depth + json.dumps(k, ensure_ascii=False) + ":"
            if isinstance(v, dict):
                yield head
                yield from lines(v, depth + 1)
            else:
                yield f"{head} {json.dumps(v, ensure_ascii=False)}"

    return "\n".join(lines({next((r.lang for r in rows if r.lang), "en"): nested(rows)}, 0)) + "\n"


def _slashed(x: str, marks: str = '"') -> str:
    for a, b in (("\\", "\\\\"), *((m, "\\" + m) for m in marks), ("\n", "\\n"), ("\t", "\\t")):
        x = x.replace(a, b)
    return x


def _android(rows: list[Row]) -> str:
    said = lambda v: escape(_slashed(v, "\"'"))
    out = []
    for key, v in families(rows).items():
        if isinstance(v, str):
            out.append(f"  <string name={quoteattr(key)}>{said(v)}</string>")
        else:
            items = "".join(f'<item quantity="{c}">{said(x)}</item>' for c, x in v.items())
            out.append(f"  <plurals name={quoteattr(key)}>{items}</plurals>")
    return "<resources>\n" + "\n".join(out) + "\n</resources>\n"


def _apple(rows: list[Row]) -> str:
    return "".join(f'"{_slashed(r.key if r.category is None else f"{r.key}[{r.category}]")}" = "{_slashed(r.value)}";\n' for r in rows)


def _stringsdict(rows: list[Row]) -> str:
    pair = lambda k, v: f"<key>{escape(k)}</key><string>{escape(v)}</string>"
    out = []
    for key, v in families(rows).items():
        forms = "".join(pair(c, x) for c, x in (v if isinstance(v, dict) else {"other": v}).items())
        rule = pair("NSStringFormatSpecTypeKey", "NSStringPluralRuleType") + pair("NSStringFormatValueTypeKey", "d")
        out.append(f"<key>{escape(key)}</key><dict>{pair('NSStringLocalizedFormatKey', '%#@n@')}<key>n</key><dict>{rule}{forms}</dict></dict>")
    return '<plist version="1.0"><dict>\n' + "\n".join(out) + "\n</dict></plist>\n"


def _gettext(rows: list[Row], template: bool = False) -> str:
    quoted = lambda x: f'"{_slashed(x)}"'
    out = ['msgid ""\nmsgstr ""\n"Content-Type: text/plain; charset=UTF-8\\n"']
    for key, v in families(rows).items():
        if isinstance(v, str):
            out.append(f"msgid {quoted(key)}\nmsgstr {quoted('' if template else v)}")
        else:
            forms = [f"msgstr[{i}] {quoted('' if template else x)}" for i, x in enumerate(v[c] for c in CATEGORIES if c in v)]
            out.append("\n".join([f"msgid {quoted(key)}", f"msgid_plural {quoted(key)}", *forms]))
    return "\n\n".join(out) + "\n"


def _xliff(rows: list[Row], new: bool) -> str:
    told = lambda x: escape(x, {"\r": "&#13;"})
    out = []
    for r in rows:
        unit, body = quoteattr(r.key if r.category is None else f"{r.key}[{r.category}]"), f"<source>{told(r.key)}</source><target>{told(r.value)}</target>"
        out.append(f"<unit id={unit}><segment>{body}</segment></unit>" if new else f"<trans-unit id={unit}>{body}</trans-unit>")
    lang = next((r.lang for r in rows if r.lang), "en")
    if new:
        return f'<xliff version="2.1" srcLang="und" trgLang="{lang}"><file id="f">\n' + "\n".join(out) + "\n</file></xliff>\n"
    return f'<xliff version="1.2"><file original="f" source-language="und" target-language="{lang}" datatype="plaintext"><body>\n' + "\n".join(out) + "\n</body></file></xliff>\n"


def _table(rows: list[Row]) -> str:
    langs = list(dict.fromkeys(r.lang or "value" for r in rows))
    cells: dict[tuple, dict[str, str]] = {}
    for r in rows:
        cells.setdefault((r.key, r.category or ""), {})[r.lang or "value"] = r.value
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerows([["key", "category", *langs], *([*k, *(v.get(lang, "") for lang in langs)] for k, v in cells.items())])
    return out.getvalue()


# ---- readers: (keep, key, category, lang, value)


def _rows(df: DataFrame, keep: Sequence[str], key: Column, value: Column, category: Column | None = None, lang: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(*keep, key.alias("key"), (none if category is None else category).alias("category"), (none if lang is None else lang).alias("lang"), value.alias("value"))


def _steps(df: DataFrame, keep: Sequence[str], text: str, form: str = "json") -> DataFrame:
    """(keep, path, value): the texts with the keys that lead to them."""
    plain = lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    found = structured.read(df, keep, text, form)
    return found.select(*keep, F.transform(F.split(F.substr("pointer", F.lit(2)), "/"), plain).alias("path"), "value")


def _families_of(found: DataFrame, keep: Sequence[str], lang: Column | None = None, by_suffix: bool = False) -> DataFrame:
    """Objects whose keys are plural categories with ``other`` among them are families; so are, ``by_suffix``, keys that end in
    _ and a category where the one with _other is there. They are told by a window, not by a join: a table of all families would
    be read from the files again, and go through the driver where the plan takes it for small."""
    whole = F.array_join("path", ".")
    if by_suffix:
        named = found.select("*", whole.alias("_key")).select("*", F.regexp_extract("_key", rf"^(.*)_(?:{'|'.join(CATEGORIES)})$", 1).alias("_stem"))
        category = F.substring_index("_key", "_", -1)
    else:
        last = F.element_at("path", -1)
        named = found.select("*", whole.alias("_key"), F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), ".").alias("_stem"))
        category = last
    of = Window.partitionBy(*keep, "_stem")
    family = (F.col("_stem") != "") & F.bool_and(category.isin(*CATEGORIES)).over(of) & F.bool_or(category == "other").over(of)
    both = named.select("*", family.alias("_family"))
    return _rows(both, keep, F.when(F.col("_family"), F.col("_stem")).otherwise(F.col("_key")), F.col("value"), F.when(F.col("_family"), category), lang)


def _read_json(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    return _families_of(_steps(df, keep, text), keep)


def _read_arb(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    lang = F.get_json_object(F.col(text), "$.@@locale")
    found = _steps(df.withColumn("_lang", lang), [*keep, "_lang"], text).where(~F.startswith(F.col("path")[0], F.lit("@")))
    # families stand in keys that end in a point and a category
    return _families_of(found.withColumn("path", F.split(F.array_join("path", "."), r"\.(?=[a-z]+$)")), keep, F.col("_lang"))


def _read_formatjs(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    found = _steps(df, keep, text).where(F.element_at("path", -1) == "defaultMessage")
    return _families_of(found.withColumn("path", F.split(F.array_join(F.slice("path", 1, F.size("path") - 1), "."), r"\.(?=[a-z]+$)")), keep)


def _read_xcstrings(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    p = F.col("path")
    found = _steps(df, keep, text).where((p[0] == "strings") & (F.get(p, F.lit(2)) == "localizations") & (F.element_at(p, -1) == "value"))
    return _rows(found, keep, p[1], F.col("value"), F.when((F.get(p, F.lit(4)) == "variations") & (F.get(p, F.lit(5)) == "plural"), F.get(p, F.lit(6))), p[3])


def _read_yaml(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    found = _steps(df, keep, text, "yaml").withColumn("_lang", F.col("path")[0]).withColumn("path", F.slice("path", 2, F.size("path")))
    return _families_of(found.where(F.size("path") > 0), keep, F.col("_lang"))


def _unslashed(x: Column) -> Column:
    guarded = F.replace(x, F.lit("\\\\"), F.lit("\u0001"))
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        guarded = F.replace(guarded, F.lit(a), F.lit(b))
    return F.replace(guarded, F.lit("\u0001"), F.lit("\\"))


def _matches(text: Column, pattern: str, *names: str) -> Column:
    return F.explode(F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names))))


def _read_android(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    bare = F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", "")
    element = r'(?s)<{0}(?=\s)[^>]*?\bname="([^"]*)"[^>]*>(.*?)</{0}>'
    said = lambda c: _unslashed(D.unescape_markup(F.col(c)))
    one = df.select(*keep, _matches(bare, element.format("string"), "k", "v").alias("m")).select(*keep, "m.*")
    many = df.select(*keep, _matches(bare, element.format("plurals"), "k", "b").alias("m")).select(*keep, "m.*")
    forms = many.select(*keep, "k", _matches(F.col("b"), r'(?s)<item\b[^>]*?\bquantity="([a-z]+)"[^>]*>(.*?)</item>', "c", "v").alias("m")).select(*keep, "k", "m.*")
    key = D.unescape_markup(F.col("k"))
    return _rows(one, keep, key, said("v")).unionByName(_rows(forms, keep, key, said("v"), F.col("c")))


def _bracketed(df: DataFrame, keep: Sequence[str], name: str, value: Column) -> DataFrame:
    """Keys that end in a category in brackets are forms of a family."""
    form = F.regexp_extract(name, rf"\[({'|'.join(CATEGORIES)})\]$", 1)
    return _rows(df, keep, F.when(form != "", F.regexp_replace(name, r"\[[a-z]+\]$", "")).otherwise(F.col(name)), value, F.nullif(form, F.lit("")))


def _read_apple(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    return _bracketed(D.apple_strings(df, keep, text), keep, "key", F.col("value"))


def _read_stringsdict(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    found = D.plural_strings(df, keep, text)
    return _rows(found, keep, D.unescape_markup(F.col("key")), F.col("value"), F.col("category"))


def _read_gettext(df: DataFrame, keep: Sequence[str], text: str, forms: Sequence[str] = ("one", "other"), template: bool = False) -> DataFrame:
    """``forms`` are the language's categories in the order of its msgstr numbers."""
    blank = r"\n[ \t]*\n"
    entry = df.select(*keep, F.explode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), blank)).alias("_e"))
    strings = r'((?:"(?:[^"\\]|\\.)*+"\s*)++)'
    joined = lambda x: _unslashed(F.array_join(F.regexp_extract_all(x, F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1)), ""))
    source = joined(F.regexp_extract("_e", rf"(?m)^msgid {strings}", 1))
    context = joined(F.regexp_extract("_e", rf"(?m)^msgctxt {strings}", 1))
    key = F.when(context != "", F.concat(context, F.lit("\u0004"), source)).otherwise(source)
    # a plain target is a form without a number
    found = entry.where(source != "").select(*keep, key.alias("_k"), source.alias("_s"), _matches(F.col("_e"), rf"(?m)^msgstr(?:\[(\d+)\])? {strings}", "n", "b").alias("m")).select(*keep, "_k", "_s", "m.*")
    category = F.get(F.array(*map(F.lit, forms)), F.expr("try_cast(nullif(n, '') as int)"))
    return _rows(found, keep, F.col("_k"), F.col("_s") if template else joined(F.col("b")), F.when(F.col("n") != "", F.coalesce(category, F.lit("other"))))


def _read_xliff(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    found = xliff.read(df, keep, text)
    return _bracketed(found, keep, "id", T.plain(F.coalesce("target", "source")))


@sliced(t.ArrayType(t.StructType([t.StructField(c.split()[0], t.StringType()) for c in ROW.split(", ")])))
def _cells(texts: list) -> list:
    def rows(x: str | None) -> list[dict]:
        head, *lines = bilingual.records(x, bilingual.separator_of(x)) if x else [[]]
        told = [c.strip() for c in head]
        at = {c.lower(): i for i, c in enumerate(told) if c.lower() in ("key", "category")}
        langs = [(i, None if c.lower() == "value" else c) for i, c in enumerate(told) if i not in at.values()]
        cell = lambda line, i: line[i] if i is not None and i < len(line) else ""
        return [{"key": cell(line, at.get("key")), "category": cell(line, at.get("category")) or None, "lang": lang, "value": line[i]} for line in lines for i, lang in langs if i < len(line) and cell(line, at.get("key"))]

    return [rows(x) for x in texts]


def _read_table(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    each = df.select(*keep, F.explode(_cells(F.col(text))).alias("_r"))
    return each.select(*keep, "_r.*")


class Form(NamedTuple):
    extension: str
    read: Callable[[DataFrame, Sequence[str], str], DataFrame]
    write: Callable[[list[Row]], str]


#: Not the inverse: a .stringsdict holds families only, so a plain text comes back as ``other``; a template holds no values, and
#: what is read are its sources; gettext and XLIFF files written here have the key as their source; languages come back from
#: .arb, .xcstrings, YAML and tables only. Texts a key of which is a category beside ``other`` are read as a family.
FORMS = {
    "json": Form("json", _read_json, lambda rows: _json(families(rows))),
    "json_nested": Form("json", _read_json, lambda rows: _json(nested(rows))),
    "i18next": Form("json", lambda df, keep, text: _families_of(_steps(df, keep, text), keep, by_suffix=True), _suffixed),
    "formatjs": Form("json", _read_formatjs, lambda rows: _json({r.key if r.category is None else f"{r.key}.{r.category}": {"defaultMessage": r.value} for r in rows})),
    "arb": Form("arb", _read_arb, _arb),
    "android": Form("xml", _read_android, _android),
    "strings": Form("strings", _read_apple, _apple),
    "stringsdict": Form("stringsdict", _read_stringsdict, _stringsdict),
    "xcstrings": Form("xcstrings", _read_xcstrings, _xcstrings),
    "yaml": Form("yml", _read_yaml, _yaml),
    "po": Form("po", _read_gettext, _gettext),
    "pot": Form("pot", lambda df, keep, text: _read_gettext(df, keep, text, template=True), lambda rows: _gettext(rows, True)),
    "xliff12": Form("xlf", _read_xliff, lambda rows: _xliff(rows, False)),
    "xliff21": Form("xlf", _read_xliff, lambda rows: _xliff(rows, True)),
    "csv": Form("csv", _read_table, _table),
}


def detect(name: Column, text: Column) -> Column:
    """The form of a file by its name and, where several go by one extension, its content; null if it can't be told."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    values = F.map_values(F.from_json(text, "map<string,string>"))
    described = F.exists(keys, lambda k: F.startswith(k, F.lit("@")) & F.array_contains(keys, F.substr(k, F.lit(2))))
    inside = lambda v, key: F.get_json_object(v, f"$.{key}").isNotNull()
    suffixed = F.exists(keys, lambda k: k.rlike(f"_(?:{'|'.join(CATEGORIES)})$"))
    by_content = (
        F.when(F.array_contains(keys, "sourceLanguage") & F.get_json_object(text, "$.strings").startswith("{"), "xcstrings")
        .when(F.array_contains(keys, "@@locale") | described, "arb")
        .when((F.size(values) > 0) & F.forall(values, lambda v: inside(v, "defaultMessage")), "formatjs")
        .when(suffixed, "i18next")
        .when(F.exists(values, lambda v: F.startswith(v, F.lit("{")) & ~inside(v, "other")), "json_nested")
        .otherwise("json")
    )
    two = F.substring(text, 1, 2000).rlike(r"""version=["']2""")
    others = {f.extension: name for name, f in FORMS.items() if f.extension not in ("json", "xlf")} | {"yaml": "yaml", "tsv": "csv"}
    told = F.when(ext == "json", by_content).when(ext.isin("xlf", "xliff"), F.when(two, "xliff21").otherwise("xliff12"))
    for e, form in others.items():
        told = told.when(ext == e, form)
    return told


def read(df: DataFrame, keep: Sequence[str], text: str, form: str) -> DataFrame:
    """(keep, key, category, lang, value) of catalogues in one form; ``keep`` names a file."""
    if form not in FORMS:
        raise ValueError(f"{form} is not one of {', '.join(FORMS)}")
    return FORMS[form].read(df, keep, text)


def read_named(df: DataFrame, keep: Sequence[str], name: str, text: str) -> DataFrame:
    """As ``read``, of files whose forms are told by their names and contents, with the form; files of no form give nothing."""
    told = df.withColumn("_form", detect(F.col(name), F.col(text)))
    out = None
    for form in FORMS:
        rows = read(told.where(F.col("_form") == form), keep, text, form).withColumn("form", F.lit(form))
        out = rows if out is None else out.unionByName(rows)
    return out


def render(rows: DataFrame, keep: Sequence[str], form: str, order: Sequence[str] = ("key",)) -> DataFrame:
    """(keep, text): a file of each ``keep`` with its rows (key, category, lang, value) in ``order``."""
    write = FORMS[form].write

    @sliced(t.StringType())
    def written(files: list) -> list:
        return [write([Row(r["key"], r["category"], r["lang"], r["value"]) for r in rs]) for rs in files]

    place = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), "category", "key", "lang", "value")
    listed = rows.groupBy(*keep).agg(F.array_sort(F.collect_list(place)).alias("_r"))
    # not deterministic in name only: a filter over the texts would be moved before them, and every file be written twice
    return listed.select(*keep, written.asNondeterministic()("_r").alias("text"))
