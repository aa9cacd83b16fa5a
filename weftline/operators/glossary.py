"""Glossary terms in segments: an equi-join of tokens and terms on the first letters, then the longest matches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions import stems
from weftline.functions import text as T
from weftline.functions.batches import sliced

# Of two matches of one length and place the kind with the smaller number wins.
PRIORITY = {"do_not_translate": 0, "mandatory": 1, "preferred": 2}


WORD = re.compile(r"[\w\u0300-\u036f]+(?:['’][\w\u0300-\u036f]+)*")
_LATIN = str.maketrans(dict(zip(T.CYRILLIC, T.LATIN, strict=True)) | T.DIGRAPHS)
TOKENS = t.ArrayType(t.StructType([t.StructField("form", t.StringType()), t.StructField("key", t.StringType()), t.StructField("start", t.IntegerType()), t.StructField("end", t.IntegerType())]))


@sliced(TOKENS)
def tokens(texts: list) -> list:
    """Words with their places: form, the form for comparing (lower case, Latin), start and end in code points."""
    return [[{"form": m[0], "key": m[0].lower().translate(_LATIN), "start": m.start(), "end": m.end()} for m in WORD.finditer(s or "")] for s in texts]


def tokens_of(lang: str | None):
    """``tokens``, or the same whose form for comparing is the word's stem if the language has rules for stems."""
    code = (lang or "").lower().replace("_", "-").split("-")[0]
    if code not in stems.LANGUAGES:
        return tokens

    @sliced(TOKENS)
    def stemmed(texts: list) -> list:
        return [[{"form": m[0], "key": stems.stem(m[0], code), "start": m.start(), "end": m.end()} for m in WORD.finditer(s or "")] for s in texts]

    return stemmed


def key_of(tok: Column, told) -> Column:
    """What forms of a word agree in: the stem, or the first four letters."""
    return F.substring(tok["key"], 1, 4) if told is tokens else tok["key"]


def matches(run: Column, pattern: Column, exact: Column, told=None) -> Column:
    """The pattern's tokens stand at the start of the run. A case-sensitive term stands as it is; of others the stems are
    equal, or the words alike but for their last letters where there are no stems."""
    same = (lambda a, b: T.loose_stem_match(a["key"], b["key"])) if told in (None, tokens) else (lambda a, b: a["key"] == b["key"])
    alike = lambda a, b: F.when(exact, a["form"] == b["form"]).otherwise(same(a, b))
    part = F.slice(run, F.lit(1), F.size(pattern))
    all_alike = (F.size(part) == F.size(pattern)) & F.forall(F.zip_with(part, pattern, alike), lambda x: x)
    return F.when(F.size(pattern) == 1, alike(run[0], pattern[0])).otherwise(all_alike)


def begun(toks: DataFrame, keep: list[str], most: int, told=tokens) -> DataFrame:
    """(keep, _run, _key): a row a token, with the next ``most`` tokens and the key in which forms agree."""
    return toks.select(*keep, F.explode(runs(F.col("_toks"), most)).alias("_run")).withColumn("_key", key_of(F.col("_run")[0], told))


def longest(terms: DataFrame, column: str) -> int:
    """The most tokens that a term of the column has, one at least."""
    return terms.agg(F.max(F.size(tokens(F.col(column))))).first()[0] or 1


def runs(toks: Column, most: int) -> Column:
    """At every token the next ``most`` tokens, itself first."""
    return F.transform(toks, lambda _, i: F.slice(toks, i + 1, most))


def find_terms(segments: DataFrame, terms: DataFrame, keep: list[str], lang: str | None = None) -> DataFrame:
    """(keep, hits): terms (term_id, kind, source_term, target_term, case_sensitive) in (keep, source), longest first, none
    over another. Forms of a word have one stem in the language, if it has rules for stems, else they are equal or agree in their
    first four letters, so that is the key of the join; a token carries as many tokens as the longest term has, not its text. Of terms on one span the best goes on, and the longest
    are chosen within each cluster of spans that overlap, so long segments take no longer a hit than short ones."""
    told = tokens_of(lang)
    pats = terms.where("kind != 'forbidden'").select("*", told(F.col("source_term")).alias("_pat")).where(F.size("_pat") > 0).withColumn("_key", key_of(F.col("_pat")[0], told))
    toks = segments.select(*keep, told(F.col("source")).alias("_toks"))
    hit = begun(toks, keep, longest(terms, "source_term"), told).join(pats, "_key").where(matches(F.col("_run"), F.col("_pat"), F.col("case_sensitive"), told))
    start, last = F.col("_run")[0]["start"], F.get("_run", F.size("_pat") - 1)["end"]
    rank = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in PRIORITY.items()), F.lit(9))
    found = hit.select(*keep, start.alias("start"), last.alias("end"), F.struct(rank.alias("rank"), "term_id", "kind", "source_term", "target_term", "case_sensitive").alias("t"))
    spans = found.groupBy(*keep, "start", "end").agg(F.min("t").alias("t"))
    order = Window.partitionBy(*keep).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    numbered = begins.withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fields = F.struct((F.col("start") - F.col("end")).alias("order"), "start", "t.rank", "t.term_id", "end", "t.kind", "t.source_term", "t.target_term", "t.case_sensitive")
    ranked = numbered.groupBy(*keep, "_cluster").agg(F.array_sort(F.collect_list(fields)).alias("ranked"))
    free = lambda acc, h: F.when(F.exists(acc, lambda x: (x["start"] < h["end"]) & (h["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(h)))
    chosen = ranked.select(*keep, F.when(F.size("ranked") == 1, F.col("ranked")).otherwise(F.aggregate("ranked", F.slice("ranked", 1, 0), free)).alias("hits"))
    whole = chosen.groupBy(*keep).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return whole.select(*keep, F.array_sort("hits", lambda a, b: a["start"] - b["start"]).alias("hits"))


def violations(hits: DataFrame, keep: list[str], target: str, most: int | None = None, lang: str | None = None) -> DataFrame:
    """(keep, term_id, code, need, found): hits whose term the target lacks as often as the source has it. ``most`` is the
    ``longest`` of the terms' targets; where it isn't given, the hits are gone through for it. ``lang`` is the target's."""
    told = tokens_of(lang)
    each = hits.select(*keep, target, F.explode("hits").alias("h"))
    need = each.groupBy(*keep, target, "h.term_id", "h.kind", "h.source_term", "h.target_term", "h.case_sensitive").agg(F.count(F.lit(1)).alias("need"))
    # the answer's tokens meet the terms of the same segment that begin alike; terms without a form of their own are found
    names = need.select("target_term", told(F.col("target_term")).alias("_pat")).distinct()
    pats = need.select(*keep, "term_id", "target_term", "case_sensitive").join(names.where(F.size("_pat") > 0), "target_term").withColumn("_key", key_of(F.col("_pat")[0], told))
    toks = hits.select(*keep, told(F.col(target)).alias("_toks"))
    met = begun(toks, keep, most or longest(need, "target_term"), told).join(pats, [*keep, "_key"]).where(matches(F.col("_run"), F.col("_pat"), F.col("case_sensitive"), told))
    seen = met.groupBy(*keep, "term_id").agg(F.count(F.lit(1)).alias("_seen"))
    both = need.join(seen, [*keep, "term_id"], "left")
    inflected = F.when(F.coalesce(F.col("target_term"), F.lit("")).rlike(r"[\p{L}\p{N}_]"), F.coalesce("_seen", F.lit(0))).otherwise(F.col("need"))
    literal = F.when(F.col("case_sensitive"), _count(F.col(target), F.col("source_term"))).otherwise(_count(F.lower(target), F.lower("source_term")))
    counted = both.withColumn("found", F.when(F.col("kind") == "do_not_translate", literal).otherwise(inflected))
    code = F.when(F.col("kind") == "do_not_translate", "dnt_changed").when(F.col("kind") == "mandatory", "term_missing").otherwise("term_preferred_missing")
    return counted.where(F.col("found") < F.col("need")).select(*keep, "term_id", code.alias("code"), "need", F.col("found").cast("long").alias("found"))


def _count(text: Column, part: Column) -> Column:
    return F.size(F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)) - 1


def forbidden(segments: DataFrame, terms: DataFrame, keep: list[str], target: str, lang: str | None = None) -> DataFrame:
    """(keep, term_id): forbidden terms that stand in the target, whatever the source says."""
    own = terms.where("kind = 'forbidden'").select("term_id", F.lit("mandatory").alias("kind"), F.coalesce("target_term", "source_term").alias("source_term"), "target_term", "case_sensitive")
    hits = find_terms(segments.select(*keep, F.col(target).alias("source")), own, keep, lang)
    return hits.select(*keep, F.explode("hits.term_id").alias("term_id")).distinct()
