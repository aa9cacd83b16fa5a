"""Rules with fixed values: rounding, bands, MQM, routing, pay, backoff, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MQM_WEIGHT = {"neutral": 0, "minor": 1, "major": 5, "critical": 25}
BAND_WEIGHT = {"context": 0.1, "exact": 0.1, "fuzzy_95": 0.3, "fuzzy_85": 0.6, "fuzzy_75": 0.8, "new": 1.0, "repetition": 0.1}
TIER_RATE = {"mt": 0.02, "ai_review": 0.04, "hybrid": 0.07, "full": 0.12}
QUOTE_MINIMUM = 5.00
THRESHOLD_LOW, THRESHOLD_HIGH, THRESHOLD_STEP = 60.0, 99.0, 0.5


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null over zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def match_band(score: Column) -> Column:
    """Translation-memory band of a match score; context matches score over 100."""
    return F.when(score > 100, "context").when(score >= 100, "exact").when(score >= 95, "fuzzy_95").when(score >= 85, "fuzzy_85").when(score >= 75, "fuzzy_75").otherwise("new")


def weight(label: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), label)


def mqm_score(penalty: Column, words: Column) -> Column:
    """100 less penalty points by 100 words, between 0 and 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - penalty * 100.0 / F.greatest(words, F.lit(1))))


def route(score: Column, blocked: Column, tier: Column, regulated: Column, threshold: float = 78.0, band: float = 8.0, offset: float = 0.0, suspended: bool = False) -> Column:
    """Where a scored segment goes."""
    edge = threshold + max(0.0, offset)
    high, inside = score >= edge + band, (score > edge - band) & (score < edge + band)
    released = F.lit("review" if suspended else "auto_approve")
    hybrid = F.when(F.lit(suspended), "review").when(high, "auto_approve").when(inside & (score >= edge), "senate").otherwise("review")
    other = F.when(high, F.lit("senate") if suspended else released).when(inside, "senate").otherwise(F.when(tier == "ai_review", "senate").otherwise("review"))
    unscored = F.when(tier == "ai_review", "senate").otherwise("review")
    return F.when(blocked, "blocked").when(regulated | (tier == "full"), "review").when(score.isNull(), unscored).when(tier == "hybrid", hybrid).otherwise(other)


def review_pay(words: Column, edited: Column, level: Column) -> Column:
    """Accepting pays by the word, editing a base and more by the word, times the level; two cents at least. Half up to five decimals."""
    times = F.when(level >= 4, 1.5).when(level == 3, 1.25).otherwise(1.0)
    each = F.when(edited, 0.01 + words * 0.012 * times).otherwise(words * 0.004 * times)
    return F.greatest(F.lit(0.02), each)


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(1800), (F.lit(5) * F.pow(F.lit(2), attempt - 1)).cast("int"))


def decay(days: Column, half_life: float = 90.0) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def calibration_grid(samples: DataFrame, score: str, escaped: str, keys: list[str]) -> DataFrame:
    """(keys, threshold, n, escaped, rate) over the threshold grid: samples at or above each threshold.

    Samples become counts by grid step first, so the reverse running sum is over at most one row a step and key.
    """
    from pyspark.sql import Window

    step = F.floor((F.least(F.col(score), F.lit(THRESHOLD_HIGH)) - THRESHOLD_LOW) / THRESHOLD_STEP).cast("int")
    counts = samples.where(F.col(score) >= THRESHOLD_LOW).groupBy(*keys, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(escaped).cast("long")).alias("escaped"))
    steps = int((THRESHOLD_HIGH - THRESHOLD_LOW) / THRESHOLD_STEP)
    grid = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    w = Window.partitionBy(*keys).orderBy(F.col("step").desc())
    filled = grid.join(counts, [*keys, "step"], "left").select(*keys, "step", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"), F.sum(F.coalesce("escaped", F.lit(0))).over(w).alias("escaped"))
    return filled.select(*keys, (F.lit(THRESHOLD_LOW) + F.col("step") * THRESHOLD_STEP).alias("threshold"), "n", "escaped", ratio(F.col("escaped"), F.col("n")).alias("rate"))


def propose_threshold(samples: DataFrame, score: str, escaped: str, keys: list[str], current: float = 78.0, target: float = 0.005, most: float = 3.0, least_samples: int = 200) -> DataFrame:
    """(keys, n_samples, threshold): the lowest grid threshold that meets the target, at most ``most`` away from the current one."""
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.sum((F.col(score) >= THRESHOLD_LOW).cast("long")).alias("usable"))
    ideal = calibration_grid(samples, score, escaped, keys).where((F.col("n") > 0) & (F.col("rate") <= target)).groupBy(*keys).agg(F.min("threshold").alias("ideal"))
    joined = n.join(ideal, keys, "left")
    moved = F.lit(current) + F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.col("ideal"), F.lit(current + most)) - current))
    bounded = F.round(F.least(F.lit(THRESHOLD_HIGH), F.greatest(F.lit(THRESHOLD_LOW), moved)), 1)
    return joined.select(*keys, "n_samples", F.when((F.col("n_samples") < least_samples) | (F.col("usable") == 0), F.lit(current)).otherwise(bounded).alias("threshold"))


def drifted(base: Column, current: Column, most: float = 0.30) -> Column:
    """The current value is off the base by more than a share of it; over a base of nothing anything is off."""
    return F.when(base <= 0, current > 0).otherwise(F.abs(current - base) / base > most)


# The plural categories of CLDR in its order, and the languages that have each set of them; others have one and other.
CATEGORIES = ("zero", "one", "two", "few", "many", "other")
PLURALS = {
    "other": "id ja km ko ms th vi zh",
    "one other": "af az bg bn da de el en et eu fa fi fil gl hi hu hy is ka kk mk nb nl nn no sq sv sw ta tr ur uz",
    "one few other": "bs hr ro sr",
    "one many other": "ca es fr it pt",
    "one two other": "he",
    "zero one other": "lv",
    "one few many other": "be cs lt pl ru sk uk",
    "one two few other": "gd sl",
    "one two few many other": "ga mt",
    "zero one two few many other": "ar cy",
}
# Languages whose category "many" is for compact or decimal numbers, so that a file need not have it, and what the
# forms of a gettext file stand for where it isn't the required categories.
MANY_IS_OPTIONAL = "ca cs es fr it lt pt sk"
GETTEXT_FORMS = {"one few many": "be pl ru uk", "one few other": "cs lt sk", "one other": "ca es fr it pt"}


def plural_table(spark: SparkSession) -> DataFrame:
    """(lang, categories, required, gettext): a row a language of the tables, in CLDR's order."""
    have = {lang: forms.split() for forms, langs in PLURALS.items() for lang in langs.split()}
    rows = []
    for lang, forms in have.items():
        required = [f for f in forms if f != "many" or lang not in MANY_IS_OPTIONAL.split()]
        gettext = next((f.split() for f, langs in GETTEXT_FORMS.items() if lang in langs.split()), required)
        rows.append((lang, forms, required, gettext))
    return spark.createDataFrame(rows, "lang string, categories array<string>, required array<string>, gettext array<string>")


def plural_forms(rows: DataFrame, lang: str) -> DataFrame:
    """``rows`` with the categories, required and gettext forms of their language, by its primary subtag; languages out of
    the table, and null, have one and other."""
    from weftline.functions.text import primary

    known = plural_table(rows.sparkSession).withColumnRenamed("lang", "_primary")
    default = F.array(F.lit("one"), F.lit("other"))
    found = rows.withColumn("_primary", primary(F.col(lang))).join(F.broadcast(known), "_primary", "left")  # a row a language
    return found.withColumns({c: F.coalesce(c, default) for c in ("categories", "required", "gettext")}).drop("_primary")


def plural_gaps(required: Column, categories: Column, given: Column) -> Column:
    """(missing, surplus): required categories that are not given, in CLDR's order, and given ones that the language hasn't;
    explicit numbers (=0) are never surplus."""
    known = F.filter(given, lambda g: ~F.startswith(g, F.lit("=")))
    return F.struct(F.array_except(required, given).alias("missing"), F.array_sort(F.array_except(known, categories)).alias("surplus"))


def source_form(category: Column, source_forms: Column) -> Column:
    """The source form that a category is translated from: its own, else other, else the first; an explicit number has only its own."""
    own, rest = F.array_contains(source_forms, category), F.when(F.array_contains(source_forms, F.lit("other")), F.lit("other")).otherwise(F.get(source_forms, F.lit(0)))
    return F.when(own, category).when(~F.startswith(category, F.lit("=")), rest)
