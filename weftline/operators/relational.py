"""Relational operators: rule matching, overlays, latest-wins, FIFO draws, running targets, gap-filled series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import prefix


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_per_group(df, keys, order, 1).drop("rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank. Spark keeps k rows a key and task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` over ``old``: one row a key. ``new`` has one row a key already."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks: an insert that may be repeated."""
    return new.dropDuplicates([key]).join(old, key, "left_anti")


def overlay(main: DataFrame, branch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The branch's row of a key where there is one, else the main row."""
    return upsert(main, branch, keys)


def most_specific(rows: DataFrame, rules: DataFrame, columns: Sequence[str], rule_id: str) -> DataFrame:
    """Each row that a rule matches, with the values of the most specific one: a null in a rule matches everything, more set
    columns win, then the smaller rule id.

    Instead of one join with ORs there is a left equi-join for every set of columns that some rule sets (at most 2 to the
    number of columns), each against rules with one row a key: the rows are read once and stay where they are while
    Spark finds the rules small enough to send.
    """
    values = [c for c in rules.columns if c not in columns and c != rule_id]
    shape = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns))
    shaped = rules.withColumn("_shape", shape)
    out, hits = rows, []
    for bits in sorted(r[0] for r in shaped.select("_shape").distinct().collect()):
        on = [c for c, bit in zip(columns, bits, strict=True) if bit == "1"]
        first = F.min(F.struct(F.lit(-len(on)).alias("_set"), rule_id, *values)).alias(f"_rule{bits}")
        own = shaped.where(F.col("_shape") == bits)
        # without columns there is one row
        out = out.join(own.groupBy(*on).agg(first), on, "left") if on else out.crossJoin(F.broadcast(own.agg(first)))
        hits.append(f"_rule{bits}")
    best = out.withColumn("_best", F.array_min(F.array_compact(F.array(*hits)))).where(F.col("_best").isNotNull())
    return best.select(*rows.columns, *(F.col("_best")[c].alias(c) for c in (rule_id, *values)))


def fifo_draws(lots: DataFrame, demand: DataFrame, keys: Sequence[str], order: Sequence[str], least: int = prefix.LEAST) -> DataFrame:
    """Draws ``demand.needed`` from ``lots.amount`` in order: take = least(amount, what earlier lots leave of the need)."""
    joined = prefix.running_sum(lots, keys, order, "amount", "_running", least).join(demand, list(keys), "left")
    rest = F.coalesce(F.col("needed"), F.lit(0)) - (F.col("_running") - F.col("amount"))
    return joined.withColumn("take", F.least(F.col("amount"), F.greatest(rest, F.lit(0)))).drop("_running")


def first_reaching(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, target: Column, at: str, least: int = prefix.LEAST) -> DataFrame:
    """For each key the smallest ``at`` by which the running sum of ``value`` reaches the target."""
    return prefix.running_sum(df, keys, order, value, "_running", least).where(F.col("_running") >= target).groupBy(*keys).agg(F.min(at).alias(at))


def month_series(df: DataFrame, at: str, aggregates: dict[str, Column], first: str, last: str) -> DataFrame:
    """Aggregates by month from first to last (yyyy-MM-dd), with zeros for months without rows."""
    spine = df.sparkSession.sql(f"select date_format(m, 'yyyy-MM') as month from (select explode(sequence(date'{first}', date'{last}', interval 1 month)) as m)")
    months = df.where((F.col(at) >= F.to_timestamp_ntz(F.lit(first))) & (F.col(at) < F.add_months(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))
    by = months.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return spine.join(by, "month", "left").select("month", *(F.coalesce(F.col(n), F.lit(0).cast(by.schema[n].dataType)).alias(n) for n in aggregates))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """prev_ and next_ of the columns within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns), *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))


def multiset_difference(a: Column, b: Column) -> Column:
    """Elements of array a beyond their number in b, sorted, repeats kept."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    distinct = F.array_sort(F.array_distinct(a))
    return F.flatten(F.transform(distinct, lambda x: F.array_repeat(x, F.greatest(count(a, x) - count(b, x), F.lit(0)))))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page with each row's place and, if more rows follow, next_offset. Only the page and one row are numbered."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    # at most limit + 1 rows
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return numbered.where(F.col("place") <= limit).withColumn("next_offset", F.when(F.col("_n") > limit, F.lit(offset + limit))).drop("_n")


def ranked_top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows with their place: each task keeps k rows, and only those are numbered."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def with_total(df: DataFrame, name: str) -> DataFrame:
    """Every row with the number of all: a count of one row is joined, so the rows stay where they are."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Optional predicates: None makes none, (low, high) a half-open range with open ends, a list membership, else equality."""
    for name, value in wanted.items():
        if isinstance(value, tuple):
            low, high = value
            df = df if low is None else df.where(F.col(name) >= low)
            df = df if high is None else df.where(F.col(name) < high)
        elif isinstance(value, list):
            df = df.where(F.col(name).isin(value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def bulk_set(df: DataFrame, named: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """``df`` with new values in the rows whose key stands in ``named``."""
    flagged = df.join(named.select(key).distinct().withColumn("_named", F.lit(True)), key, "left")
    return flagged.select(*(F.when(F.col("_named"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def without(df: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """The rows of ``df`` that have no partner in ``gone``."""
    match = [df[a] == gone[b] for a, b in on.items()]
    return df.join(gone, match, "left_anti")


def blob_key(org: Column, kind: Column, key: Column, filename: Column) -> Column:
    return F.concat_ws("/", org, kind, key.cast("string"), F.regexp_replace(filename, "[^A-Za-z0-9._-]+", "_"))


def renumbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Gap-free numbers from 1 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def running_sum(value: Column | str, keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def ledger(movements: DataFrame, key: str, credit: Column, debit: Column, amount: str) -> DataFrame:
    """Double entry (key, account, amount): plus on the credited account, minus on the debited one."""
    sides = F.array(F.struct(credit.alias("account"), F.col(amount).alias("amount")), F.struct(debit.alias("account"), (-F.col(amount)).alias("amount")))
    return movements.select(key, F.explode(sides).alias("side")).select(key, "side.*")


def merge_outcome(branch: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """Three-way comparison of branch (key, base, mine) and main (key, version, value): same, merge or conflict."""
    outcome = F.when(F.col("mine").eqNullSafe(F.col("value")), "same").when(F.col("base").eqNullSafe(F.col("version")), "merge").otherwise("conflict")
    return branch.join(main, key).withColumn("outcome", outcome)


def numbered_in_steps(df: DataFrame, keys: Sequence[str], step: str, order: Sequence[Column], name: str) -> DataFrame:
    """Gap-free numbers within the keys, where ``step`` rises with the order: rows are numbered within each step and the
    counts of earlier steps are added, so that no task holds more than a step of a key."""
    inner = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, step).orderBy(*order)))
    counts = df.groupBy(*keys, step).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*keys, step, (F.sum("_n").over(Window.partitionBy(*keys).orderBy(step)) - F.col("_n")).alias("_before"))
    return inner.join(before, [*keys, step]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def longest_name(texts: DataFrame, text: str, names: DataFrame, name: str, tie: str) -> DataFrame:
    """Each text with the longest name it holds, without case; a join on the first word of the names keeps it an equi-join."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    asked = texts.select(text, F.explode(words).alias("_word"))
    keyed = names.withColumn("_word", F.regexp_extract(F.lower(name), r"[\p{L}\p{N}]+", 0))
    hits = asked.join(keyed, "_word").where(F.contains(F.lower(text), F.lower(name)))
    best = F.max(F.struct(F.length(name).alias("n"), (-F.col(tie)).alias("t"), F.col(name).alias("x")))
    return hits.groupBy(text).agg(best.alias("_b")).select(text, F.col("_b.x").alias(name))


def bundle_digests(df: DataFrame, keys: Sequence[Column], place: Column, entry: Column, block: int) -> DataFrame:
    """(keys, keys n, digest): SHA-256 over the digests of blocks of ``block`` places, each over its entries in order."""
    rows = df.select(*keys, F.floor(place / block).alias("_block"), place.alias("_place"), entry.alias("_entry"))
    names = [c for c in rows.columns if not c.startswith("_")]
    sha = lambda parts, sep: F.sha2(F.array_join(parts, sep).cast("binary"), 256)
    blocks = rows.groupBy(*names, "_block").agg(F.count(F.lit(1)).alias("_n"), sha(F.array_sort(F.collect_list(F.struct("_place", "_entry")))["_entry"], ",").alias("_digest"))
    return blocks.groupBy(*names).agg(F.sum("_n").alias("keys"), sha(F.array_sort(F.collect_list(F.struct("_block", "_digest")))["_digest"], "").alias("digest"))


def replayed(log: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], entry: Column) -> DataFrame:
    """(keys, changes, fields, history) of an append-only log: each field's last value that isn't null, and a digest of the
    entries in order. ``order`` must tell a key's changes apart; a key's log is one row, like the evidence it goes into."""
    place = F.struct(*order)
    last = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    told = F.transform(F.array_sort(F.collect_list(F.struct(*order, entry.alias("_entry")))), lambda x: x["_entry"])
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes"), *last, F.sha2(F.array_join(told, ",").cast("binary"), 256).alias("history"))
