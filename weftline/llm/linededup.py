"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

A text is split at newlines. Lines without a word (``[^\\x20\\x09-\\x0D]+``) stand in no window. A window is three
consecutive lines with words. Windows are compared through 128 bits of hash over all documents. The first occurrence, by id and then by position,
stays; the lines that any later occurrence covers go, with blank lines between them.

Lines are compared whole: a long passage inside different lines, in a line with one other word, or in fewer than three
lines of a longer text, is not found and stays.

Defined results: a text with one or two lines with words has these as its only window, so that whole short copies go; a null text stays null, an empty text stays empty. Rows equal in id and text are one document and
get the same result. A null id sorts first. Empty tables give empty results. Other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh

WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """The lines with words: position p, two hashes a and b."""
    split = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("p"), x.rlike(WORD).alias("worded"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    return F.filter(split, lambda s: s["worded"])


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a window: id, t (hash of the text), p and q (its first and last line), a and b (its hash)."""
    lines = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), _lines(F.col(text_col)).alias("l")).where(F.size("l") > 0)

    def window(i: Column, k: int, kind: int) -> Column:
        got = [F.get("l", i + j) for j in range(k)]
        return F.struct(got[0]["p"].alias("p"), got[-1]["p"].alias("q"), *(F.xxhash64(F.lit(kind), *(x[h] for x in got)).alias(h) for h in "ab"))

    n = F.size("l")
    threes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i, 3, 3))).when(n == 2, F.array(window(F.lit(0), 2, 2))).otherwise(F.array(window(F.lit(0), 1, 1)))
    return lines.select("id", "t", F.explode(F.array_distinct(threes)).alias("w")).select("id", "t", "w.*")


def repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each document with later occurrences: id, t and the covered positions, merged."""
    all_windows = windows(docs, id_col, text_col)
    place = F.struct("id", "t", "p")
    firsts = all_windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    later = all_windows.join(firsts, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    spans = later.groupBy("id", "t").agg(F.collect_set(F.struct("p", "q")).alias("spans"))
    return spans.select("id", "t", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["p"], s["q"])))).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with later occurrences of repeated windows taken out of the text; ``removed_col`` gets the lines removed."""
    gone = repeated(docs, id_col, text_col)
    i, t, c = (fresh(docs, x) for x in ("_line_id", "_line_text", "_line_covered"))
    gone = gone.toDF(i, t, c)
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(t)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(c))
    text = F.when(F.col(c).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n"))
    out = [text.alias(x) if x == text_col else F.col(x) for x in docs.columns]
    return joined.select(*out, *([F.coalesce(F.size(c), F.lit(0)).cast("long").alias(removed_col)] if removed_col else []))
