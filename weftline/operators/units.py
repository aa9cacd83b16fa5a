"""Units of translation: outer white space apart from segments, codes that may be written back, segments that fit a target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.sources import plain


def built(text: Column, segment: bool = True) -> Column:
    """A unit (leading, segments (text, trailing)) of a text, or null if it has nothing but space and codes.

    White space at the start is leading; that after each segment is trailing; ``joined`` gives the text back.
    """
    leading = F.regexp_extract(text, r"^\s*", 0)
    core = F.substr(text, F.length(leading) + 1)
    parts = plain.sentences(core) if segment else F.array(core)
    trailing = lambda x: F.regexp_extract(x, r"\s*$", 0)
    segments = F.transform(parts, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - F.length(trailing(x))).alias("text"), trailing(x).alias("trailing")))
    return F.when(F.trim(F.regexp_replace(T.plain(text), r"\s+", "")) != "", F.struct(leading.alias("leading"), segments.alias("segments")))


def joined(unit: Column) -> Column:
    return F.concat(unit["leading"], F.array_join(F.transform(unit["segments"], lambda s: F.concat(s["text"], s["trailing"])), ""))


def refused(source: Column, target: Column) -> Column:
    """Why a target's codes may not be written back, or null: all problems but a pair dropped whole, which loses form only."""
    return F.get(F.filter(T.tag_problems(source, target), lambda p: p != "tag_pair_dropped"), F.lit(0))


def fitted(text: Column, n: Column) -> Column:
    """The unit with as many segments as its target has: by sentences, by lines, or whole; null if none fits."""
    whole, cut = built(text, segment=False), built(text)
    lines = F.filter(F.split(F.regexp_replace(text, r"(\n\s*)", "$1\u0001"), "\u0001", -1), lambda x: x.rlike(r"\S"))
    by_line = F.struct(F.lit("").alias("leading"), F.transform(lines, lambda x: F.struct(x.alias("text"), F.lit("").alias("trailing"))).alias("segments"))
    fits = lambda u: F.size(u["segments"]) == n
    return F.when(fits(cut), cut).when(fits(by_line) & (joined(by_line) == text), by_line).when(fits(whole), whole)
