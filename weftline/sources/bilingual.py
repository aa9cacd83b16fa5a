"""Inputs of an audit: pairs of source and target from tables, XLIFF, memories, or two documents that are aligned."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.batches import each_row
from weftline.operators import alignment
from weftline.sources import documents, plain

# Words that the headings of the two columns begin with, and the separators of tables.
SOURCE_HEAD, TARGET_HEAD = r"(?i)^\s*(?:source|src|original)\b", r"(?i)^\s*(?:target|tgt|translation)\b"
SEPARATORS = ",;\t|"
CELL = re.compile(r' *"((?:[^"]|"")*)" *')
MARK = re.compile(r'(?<![^,;\t|\r\n])"(?:[^"]|"")*"|[,;\t|\r\n]')


def each_record(text: str, separator: str) -> Iterator[list[str]]:
    """The records of a table: cells between separators, quoted ones with line breaks and doubled quotes. A quote inside a
    bare cell, and one that is never closed, are characters."""
    plain = re.compile(rf"[^{re.escape(separator)}\r\n]*")
    row: list[str] = []
    at = 0
    while at < len(text):
        m = CELL.match(text, at)
        if m and (m.end() == len(text) or text[m.end()] in separator + "\r\n"):
            row.append(m[1].replace('""', '"'))
        else:
            m = plain.match(text, at)
            row.append(m[0])
        at = m.end()
        if at < len(text) and text[at] == separator:
            at += 1
            if at < len(text):
                continue
            row.append("")
        at += 2 if text[at : at + 2] == "\r\n" else 1
        yield row
        row = []


def records(text: str, separator: str, most: int | None = None) -> list[list[str]]:
    return list(islice(each_record(text, separator), most))


def separator_of(text: str) -> str:
    """The separator that the first record has most of outside quotes; of equals the first of ``SEPARATORS``."""
    counts = dict.fromkeys(SEPARATORS, 0)
    for m in MARK.finditer(text):
        if m[0] in "\r\n":
            break
        if m[0] in counts:
            counts[m[0]] += 1
    return max(SEPARATORS, key=counts.get)


def _rows(text: str | None) -> Iterator[tuple]:
    """The records with a text in them, each with the first one."""
    bare = (text or "").removeprefix("\ufeff")
    told = (r for r in each_record(bare, separator_of(bare)) if any(c.strip() for c in r))
    names = next(told, None)
    for n, r in enumerate(() if names is None else chain([names], told)):
        yield n, names, r


def table_pairs(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, source, target) of tables of any width: by the headings of the first record, else the first two columns."""
    rows = each_row(df, keep, text, "n int, _names array<string>, _cells array<string>", _rows)
    at = lambda pattern: F.array_position(F.transform("_names", lambda x: x.rlike(pattern)), True)
    both = (at(SOURCE_HEAD) > 0) & (at(TARGET_HEAD) > 0)
    cell = lambda pattern, first: F.coalesce(F.get("_cells", F.when(both, at(pattern) - 1).otherwise(first).cast("int")), F.lit(""))
    pairs = rows.where(~both | (F.col("n") > 0)).select(*keep, "n", cell(SOURCE_HEAD, 0).alias("source"), cell(TARGET_HEAD, 1).alias("target"))
    return pairs.where(F.trim("source") != "").withColumns({c: T.escape_brackets(F.col(c)) for c in ("source", "target")})


def xliff_pairs(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, source, target) of the segments that have a source."""
    found = documents.xliff(df, keep, text)
    return found.where(F.trim(T.plain(F.col("source"))) != "").select(*keep, "n", "source", F.coalesce("target", F.lit("")).alias("target"))


def memory_text_pairs(df: DataFrame, keep: Sequence[str], text: str, source: str, target: str) -> DataFrame:
    """(keep, n, source, target) of the units of memories in two languages, every variant with every other."""
    units = documents.tmx_units(df, keep, text)
    side = lambda lang, name: F.filter("variants", lambda v: T.primary(v["lang"]) == lang).alias(name)
    told = units.select(*keep, "n", F.explode(side(source, "s")).alias("s"), "variants").select(*keep, "n", "s", F.explode(side(target, "t")).alias("t"))
    return told.select(*keep, "n", F.col("s.text").alias("source"), F.col("t.text").alias("target"))


def document_pairs(df: DataFrame, keep: Sequence[str], source: str, target: str) -> DataFrame:
    """(keep, n, source, target, extra) of two documents' sentences; extra: sentences of the target that none stands for."""
    sides = df.select(*keep, *(F.transform(plain.sentences(F.col(c)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))).alias(a) for c, a in ((source, "_s"), (target, "_t"))))
    beads = alignment.align(sides, [*keep, "_s", "_t"], F.col("_s"), F.col("_t"))
    joined = lambda side, places: T.escape_brackets(F.array_join(F.transform(places, lambda i: F.get(side, i)), " "))
    extra = F.aggregate(F.filter("beads", lambda b: F.size(b["src"]) == 0), F.lit(0), lambda n, b: n + F.size(b["tgt"]))
    each = beads.select(*keep, "_s", "_t", extra.alias("extra"), F.posexplode(F.filter("beads", lambda b: F.size(b["src"]) > 0)).alias("n", "b"))
    return each.select(*keep, "n", joined(F.col("_s"), F.col("b.src")).alias("source"), joined(F.col("_t"), F.col("b.tgt")).alias("target"), "extra")


def read(df: DataFrame, keep: Sequence[str], kind: str, text: str, source: str, target: str) -> DataFrame:
    """(keep, n, source, target) of files of several kinds: ``kind`` says table, xliff or memory; other kinds give nothing."""
    of = lambda k: df.where(F.col(kind) == k)
    return table_pairs(of("table"), keep, text).unionByName(xliff_pairs(of("xliff"), keep, text)).unionByName(memory_text_pairs(of("memory"), keep, text, source, target))
