"""Imports into a translation memory, with an account of every file: what each pair does, what the memory holds after, what was
left out and why.

Pairs count in the order of their files. A pair whose key is new is inserted; one with the target that its key has at that moment
is unchanged; an import never replaces a reviewed target, which is kept; all else updates. What a key holds at a pair is what the
pair before it in that key brought, so one look at the row before decides, without a loop over rows or chunks; a key that holds
many of the rows is cut by ``prefix.previous``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions import text as T
from weftline.operators import prefix, steps

KEY = ("source_lang", "target_lang", "source_key", "context")
ENTRY = "source_lang string, target_lang string, source_key string, context string, source string, target string, origin string, status string, rights string"
SERVED = ("approved", "imported")


def language(lang: Column) -> Column:
    return F.lower(F.replace(F.trim(lang), F.lit("_"), F.lit("-")))


def entries(spark: SparkSession, rows: Sequence[tuple] = ()) -> DataFrame:
    """A memory of given rows, by default an empty one."""
    return spark.createDataFrame(list(rows), ENTRY)


def keyed(df: DataFrame) -> DataFrame:
    """``df`` (source_lang, target_lang, context, source, ...) with languages in one form and ``source_key``."""
    named = df.withColumn("source_lang", language(F.col("source_lang"))).withColumn("target_lang", language(F.col("target_lang")))
    return named.withColumn("source_key", T.source_key(F.col("source"), F.col("source_lang")))


def _blank(text: str) -> Column:
    return T.squeeze(T.plain(F.coalesce(F.col(text), F.lit("")))) == ""


def pairs(units: DataFrame, keep: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keep, order, k, key, source, target, left_out): a row a pair, and a row a unit that gives none, with the reason.

    ``units`` are those of ``memories.units``; ``order`` are its columns by which files and units follow one another, the first
    one a number.
    """
    reason = F.when(F.col("fault").isNotNull(), "error").when(F.col("source").isNull() | _blank("source"), "skipped")
    told, named = units.withColumn("left_out", reason), list(dict.fromkeys([*keep, *order]))
    out = told.where("left_out is not null").select(*named, F.lit(-1).alias("k"), "left_out", "fault")
    each = told.where("left_out is null").select(*named, "context", "source_lang", "source", F.posexplode("targets").alias("k", "_t"))
    rows = keyed(each.select("*", F.col("_t.lang").alias("target_lang"), F.col("_t.text").alias("target")).drop("_t"))
    rows = rows.withColumn("left_out", F.when(_blank("target"), "skipped"))
    return rows.unionByName(out, allowMissingColumns=True)


def actions(memory: DataFrame, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (key, target, order) with ``action``. ``memory`` is of the form ``ENTRY`` and has one row a key."""
    before = prefix.previous(rows, KEY, [*order, "k"], "target", "_before")
    held = memory.select(*KEY, F.col("target").alias("_held"), F.col("status").isin(*SERVED).alias("_served"), ((F.col("status") == "approved") & (F.col("origin") != "import")).alias("_reviewed"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in KEY]
    both = before.alias("r").join(held.alias("m"), same, "left").select("r.*", "m._held", "m._served", "m._reviewed")
    now = F.when(F.coalesce("_reviewed", F.lit(False)) | F.col("_before").isNull(), F.when(F.col("_served"), F.col("_held"))).otherwise(F.col("_before"))
    action = (
        F.when(F.col("_held").isNull() & F.col("_before").isNull(), "inserted")
        .when(now == F.col("target"), "unchanged")
        .when(F.col("_reviewed"), "kept")
        .otherwise("updated")
    )
    return both.withColumn("action", action).drop("_before", "_held", "_served", "_reviewed")


def changed(done: DataFrame, order: Sequence[str], rights: str) -> DataFrame:
    """The entries that an import writes: for each key with an insertion or an update, what its last pair says."""
    last = F.max_by(F.struct("source", "target"), F.struct(*order, "k"))
    written = done.groupBy(*KEY).agg(last.alias("_l"), F.bool_or(F.col("action").isin("inserted", "updated")).alias("_w")).where("_w")
    return written.select(*KEY, "_l.source", "_l.target", F.lit("import").alias("origin"), F.lit("imported").alias("status"), F.lit(rights).alias("rights"))


def accounts(done: DataFrame, left_out: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, imported, skipped, errors) of pairs with actions and of what was left out."""
    told = F.when(F.col("action").isin("inserted", "updated"), "imported").otherwise("skipped")
    both = done.select(*keep, told.alias("_as")).unionByName(left_out.select(*keep, F.when(F.col("left_out") == "error", "errors").otherwise("skipped").alias("_as")))
    return both.groupBy(*keep).agg(*(F.count_if(F.col("_as") == c).alias(c) for c in ("imported", "skipped", "errors")))


def _owner(rights: str) -> str:
    if not (rights or "").strip():
        raise ValueError("an import needs the name of who confirms the rights")
    return rights.strip()


def import_units(memory: DataFrame, units: DataFrame, keep: Sequence[str], order: Sequence[str], rights: str) -> tuple[DataFrame, DataFrame]:
    """(changed entries, accounts by ``keep``) of units imported into a memory; ``rights`` names who confirms the rights.

    Units and pairs are written below the shared folder first: what follows goes through them several times, and units are costly to read.
    """
    owner = _owner(rights)
    rows = steps.written(pairs(steps.written(units), keep, order))
    done = actions(memory, rows.where("left_out is null"), order)
    return changed(done, order, owner), accounts(done, rows.where("left_out is not null"), keep)


def merged(memory: DataFrame, changes: DataFrame) -> DataFrame:
    """A memory with changed entries in the place of those with their keys."""
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"c.{k}")) for k in KEY]
    return memory.alias("m").join(changes.alias("c"), same, "left_anti").unionByName(changes)


def create(memory: DataFrame, store: str) -> None:
    """A store for imports that come in batches: the entries of each batch stand beside those of the batches before it."""
    memory.write.mode("errorifexists").parquet(f"{store}/entries/batch=-1")


def current(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The memory in a store, or what it was before a batch: of each key the entry of its last batch."""
    log = spark.read.schema(f"{ENTRY}, batch long").parquet(f"{store}/entries")
    log = log if before is None else log.where(F.col("batch") < before)
    values = [c for c in log.columns if c not in (*KEY, "batch")]
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*KEY, "_v.*")


def import_stream(units: DataFrame, keep: Sequence[str], order: Sequence[str], rights: str, store: str, checkpoint: str) -> StreamingQuery:
    """Imports units as their files arrive, all there are, then stops; a later call goes on behind its checkpoint.

    Each batch reads what the store was before it and writes its entries and accounts under its number. A batch that is done
    again after a stop overwrites what it wrote and reads the same, so it counts once.
    """
    owner = _owner(rights)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        changes, told = import_units(current(spark, store, number), rows, keep, order, owner)
        changes.write.mode("overwrite").parquet(f"{store}/entries/batch={number}")
        # actions compare with the store before this batch, so the accounts are the same after its entries are there
        told.write.mode("overwrite").parquet(f"{store}/accounts/batch={number}")

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
