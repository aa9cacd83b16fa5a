"""Plain text: paragraphs, sentences, splices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, paragraph): runs between blank lines; null and empty texts have none."""
    parts = df.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"\n[ \t]*\n", -1)).alias("n", "paragraph"))
    return parts.where(F.trim("paragraph", F.lit("\n ")) != "")


def spliced(pieces: DataFrame, key: str, at: str, piece: str) -> DataFrame:
    """(key, text): pieces joined in the order of their offsets."""
    return pieces.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct(at, piece)))[piece], "").alias("text"))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after a final mark and closing quotes before a space and a capital or a digit; single-letter
    and common abbreviations don't end one. The pieces joined give the text back."""
    cut = F.regexp_replace(text, r"(?<!\b[A-Z])(?<!\b(?:Dr|Mr|Ms|St|Nr|No|ca|vs))([.!?…。！？]+[\"'”»)\]]*)(\s+)(?=[\p{Lu}\p{N}¿¡\"“«])", "$1$2\u0001")
    return F.filter(F.split(cut, "\u0001", -1), lambda x: x != "")
