"""Translation memory: match ladder, upsert rules, inconsistencies, trigram similarity, term extraction, co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import language
from weftline.functions import text as T
from weftline.operators import relational as ops
from weftline.operators import steps


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(id, keep, seq, line): the lines of a text that hold something; a line feed ends one."""
    return docs.select(id_col, *keep, F.posexplode(F.split(text_col, "\n", -1)).alias("seq", "line")).where(F.trim("line") != "")


def exact_matches(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """``segments`` (source_key, context_key, ...) with score: 101 if an entry has both keys, 100 if one has the source, else 0.

    Entries are reduced to distinct keys first, so a hot text is one row; what is left are two equi-joins.
    """
    both = entries.select("source_key", "context_key").distinct().withColumn("_both", F.lit(True))
    one = both.select("source_key").distinct().withColumn("_one", F.lit(True))
    found = segments.join(both, ["source_key", "context_key"], "left").join(one, "source_key", "left")
    return found.withColumn("score", F.when(F.col("_both"), 101.0).when(F.col("_one"), 100.0).otherwise(0.0)).drop("_both", "_one")


def upsert_actions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): inserted; unchanged if the target is the same; kept if a reviewed target meets an import; else updated.

    ``old`` has target and reviewed, ``new`` target and imported; both have one row a key.
    """
    both = old.select(*keys, F.col("target").alias("_old"), "reviewed").join(new.select(*keys, F.col("target").alias("_new"), "imported"), keys, "right")
    action = F.when(F.col("reviewed").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "unchanged").when(F.col("reviewed") & F.col("imported"), "kept").otherwise("updated")
    return both.select(*keys, action.alias("action"))


def inconsistencies(pairs: DataFrame, by: str, other: str) -> DataFrame:
    """Values of ``by`` (without case and extra space) with more than one ``other``: by, n (pairs) and others (distinct)."""
    norm = lambda c: F.lower(T.squeeze(F.col(c)))
    grouped = pairs.groupBy(norm(by).alias(by)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(norm(other)).alias("others"))
    return grouped.where("others > 1")


def similar_pairs(queries: DataFrame, rows: DataFrame, least: float = 0.3, word: str = T.LETTERS) -> DataFrame:
    """(query, id, sim) of (query, text) against (id, text): Jaccard over distinct trigrams, at or above ``least``.

    An inverted index: both sides are exploded to trigrams and joined, and common trigrams are counted. A pair that
    reaches the least similarity shares a trigram among the rarest of each side (prefix filter), so only those are
    joined; candidates are then verified on the full sets.
    """
    q = queries.select("query", T.trigrams(F.col("text"), word).alias("g")).where(F.size("g") > 0)
    r = rows.select("id", T.trigrams(F.col("text"), word).alias("g")).where(F.size("g") > 0)
    each = r.select(F.explode("g").alias("t")).union(q.select(F.explode("g").alias("t")))
    freq = each.groupBy("t").agg(F.count(F.lit(1)).alias("f"))

    def rare(df: DataFrame, key: str) -> DataFrame:
        ranked = df.select(key, F.size("g").alias("n"), F.explode("g").alias("t")).join(freq, "t")
        whole = ranked.groupBy(key).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
        kept = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
        return whole.select(key, F.explode(F.transform(kept, lambda x: x["t"])).alias("t"))

    candidates = rare(q, "query").join(rare(r, "id"), "t").select("query", "id").distinct()
    sized = candidates.join(q, "query").join(r.select("id", F.col("g").alias("h")), "id")
    common = F.size(F.array_intersect("g", "h"))
    return sized.select("query", "id", (common / (F.size("g") + F.size("h") - common)).alias("sim")).where(F.col("sim") >= least)


def word_similar(lines: DataFrame, text_col: str, phrases: list[str], least: float = 0.6) -> DataFrame:
    """``lines`` with phrase and similarity, where a stretch of the line is like the phrase by ``least`` or more.

    Phrases are what a user asks for: a short list, carried in the plan, so that the lines are read once and not shuffled. A line
    goes on to be measured only with enough of a phrase's trigrams: of n, at least n times ``least``.
    """
    asked = F.array(*(F.struct(F.lit(p).alias("phrase"), T.trigrams(F.lit(p)).alias("q")) for p in phrases))
    each = lines.select("*", T.trigrams(F.col(text_col)).alias("_g"), asked.alias("_asked"))
    enough = lambda a: (F.size(a["q"]) > 0) & (F.size(F.array_intersect(a["q"], "_g")) >= F.size(a["q"]) * F.lit(least))
    met = each.select("*", F.explode(F.filter("_asked", enough)).alias("_a")).drop("_asked")
    told = met.withColumn("similarity", language.word_similarity("_a.phrase", text_col)).where(F.col("similarity") >= least)
    return told.withColumn("phrase", F.col("_a.phrase")).drop("_a", "_g")


def concordance(entries: DataFrame, phrase: str, sides: list[str], order: list[Column], limit: int = 25) -> DataFrame:
    """Entries that hold a phrase on one of the sides, whatever the case, with rank, phrase and the similarity of the side that is more like it:
    the ``limit`` most alike, ties by ``order``. Each task keeps its best before they meet."""
    holds = [F.contains(F.lower(c), F.lit(phrase.lower())) for c in sides]
    found = entries.where(F.coalesce(*(F.when(h, True) for h in holds), F.lit(False)))
    alike = F.greatest(*(language.word_similarity(F.lit(phrase), c) for c in sides), F.lit(0.0))
    told = found.withColumn("similarity", alike).withColumn("phrase", F.lit(phrase))
    return ops.top_per_group(told, ["phrase"], [F.col("similarity").desc(), *order], limit)


def _runs(words: Column, n: int) -> Column:
    """Every run of ``n`` words as a struct of its words; those at the end, which have fewer, hold nulls."""
    return F.arrays_zip(*(F.slice(words, k + 1, F.size(words)).alias(f"_{k}") for k in range(n)))


def _frequent_runs(rows: DataFrame, keys: list[str], inner: DataFrame, floors: DataFrame, n: int) -> DataFrame:
    """(keys, term, freq) of the runs of ``n`` words that their key has as often as its floor. Both runs within such a run are as
    frequent (``inner``), so no other is counted."""
    at = [f"_{k}" for k in range(n)]
    each = rows.select(*keys, F.inline(_runs(F.col("_w"), n)).alias(*at)).where(F.col(at[-1]).isNotNull())
    for part in (at[:-1], at[1:]):
        each = each.alias("l").join(inner.alias("h"), [*(F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys), F.concat_ws(" ", *part) == F.col("h.term")], "left_semi")
    return _above(each.groupBy(*keys, F.concat_ws(" ", *at).alias("term")).agg(F.count(F.lit(1)).alias("freq")), keys, floors)


def _above(counted: DataFrame, keys: list[str], floors: DataFrame) -> DataFrame:
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    return counted.alias("l").join(floors.alias("h"), [*same, F.col("l.freq") >= F.col("h._floor")], "left_semi")


def extract_terms(rows: DataFrame, words: Column, keys: list[str], most: int = 3, least: int = 2, limit: int = 50) -> DataFrame:
    """(keys, term, freq, rank): frequent word runs of each key, up to ``most`` words.

    A run goes if a longer one that holds it is as frequent; the rest ranks by frequency times 1 + half a point a
    further word. Each longer run names its two inner runs, so the containment test is one equi-join.

    Only runs that may be among the first are counted. Of a key's ``most * limit`` most frequent words, the last with frequency
    u, each is within a run that stays and is as frequent; a run has at most ``most`` words, so ``limit`` runs stay with u points
    or more. A run below u / (1 + (most - 1) / 2) has fewer points whatever its length: that is the key's floor. Where a key has
    fewer words it is ``least``, and all is counted. Words are counted first, then runs by length, so rows are gone through ``most`` times.
    """
    told = rows.select(*keys, words.alias("_w"))
    singles = steps.written(told.select(*keys, F.explode("_w").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least))
    first = ops.top_per_group(singles, keys, [F.col("freq").desc()], most * limit).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("freq").alias("_u"))
    reach = F.ceil(F.col("_u") / (1 + 0.5 * (most - 1)))
    floors = steps.written(first.select(*keys, F.when(F.col("_n") == most * limit, F.greatest(F.lit(least), reach)).otherwise(least).alias("_floor")))
    levels = [steps.written(_above(singles, keys, floors))]
    for size in range(2, most + 1):
        levels.append(steps.written(_frequent_runs(told, keys, levels[-1], floors, size)))
    counted = reduce(DataFrame.unionByName, levels)
    parts = F.split("term", " ")
    n = F.size(parts)
    inner = counted.where(n > 1).select(*keys, F.explode(F.array(F.array_join(F.slice(parts, F.lit(1), n - 1), " "), F.array_join(F.slice(parts, F.lit(2), n - 1), " "))).alias("term"), "freq")
    covered = inner.groupBy(*keys, "term").agg(F.max("freq").alias("_longer"))
    kept = counted.join(covered, [*keys, "term"], "left").where(F.col("_longer").isNull() | (F.col("_longer") < F.col("freq"))).drop("_longer")
    score = F.col("freq") * (1 + 0.5 * (n - 1))
    return ops.top_per_group(kept.withColumn("_score", score), keys, [F.col("_score").desc(), F.col("term")], limit).drop("_score")


# Words of more than this share of all pairs are hot; a task counts what about this many pairs of words come to.
HOT, COUNTED = 1 / 1000, 4_000_000


def dice(pairs: DataFrame, source: str, target: str, least: float = 0.2, top: int = 3) -> DataFrame:
    """(s, t, c, dice): co-occurrence over the rows of ``pairs`` (source words, target words); the best few of each word.

    Counts are over distinct words of a pair: 2c / (m + f). Only words that would reach ``least`` if they were always together
    meet, so how often each occurs is joined to the words first. A source word goes to where it is counted with a list of what it
    meets, which is a few bytes a word, where a row a pair of words is some fifty. Hot words meet few others, for none is
    rare; their pairs are counted where they are, then added up. There are as many tasks as pairs of words ask for, so that the
    counts of one don't grow with the input.
    """
    bags = steps.written(pairs.select(F.monotonically_increasing_id().alias("key"), F.array_distinct(source).alias("a"), F.array_distinct(target).alias("b")))
    rows, work = bags.agg(F.count(F.lit(1)), F.sum(F.size("a").cast("long") * F.size("b"))).first()
    src, tgt = bags.select("key", F.explode("a").alias("s")), bags.select("key", F.explode("b").alias("t"))
    m, f = src.groupBy("s").agg(F.count(F.lit(1)).alias("m")), tgt.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    lists = tgt.join(f, "t").groupBy("key").agg(F.collect_list(F.struct("t", "f")).alias("ts"))
    alike = lambda c: 2 * c / (F.col("m") + F.col("f"))
    near = F.filter("ts", lambda x: 2 * F.least("m", x["f"]) / (F.col("m") + x["f"]) >= least)
    each = src.join(m, "s").join(lists, "key").select("s", "m", near.alias("ts")).where(F.size("ts") > 0)
    hot = F.col("m") > rows * HOT
    counted = lambda met: met.select("s", "m", F.inline("ts")).groupBy("s", "m", "t", "f").agg(F.count(F.lit(1)).alias("c")).withColumn("dice", alike(F.col("c"))).where(F.col("dice") >= least)
    both = counted(each.where(~hot).repartition(max(1, (work or 0) // COUNTED), "s")).unionByName(counted(each.where(hot)))
    return ops.top_per_group(both, ["s"], [F.col("dice").desc(), F.col("c").desc(), F.col("t")], top)


def consistency(segments: DataFrame, source: str, target: str) -> DataFrame:
    """``segments`` with flags: the source has other targets elsewhere, the target has other sources.

    Distinct pairs are counted by each side and joined back, so a hot text is not gathered.
    """
    pairs = segments.select(source, target).distinct()
    a = pairs.groupBy(source).agg((F.count(F.lit(1)) > 1).alias("many_targets"))
    b = pairs.groupBy(target).agg((F.count(F.lit(1)) > 1).alias("many_sources"))
    return segments.join(a, source).join(b, target)


def contexts(lines: DataFrame, key: str, seq: str, line: str) -> DataFrame:
    """``lines`` with source_key and context_key of each line's neighbours."""
    w = Window.partitionBy(key).orderBy(seq)
    near = lines.withColumn("_before", F.lag(line).over(w)).withColumn("_after", F.lead(line).over(w))
    return near.withColumn("source_key", T.source_key(F.col(line), F.col("lang"))).withColumn("context_key", T.context_key(F.col("_before"), F.col("_after"))).drop("_before", "_after")
