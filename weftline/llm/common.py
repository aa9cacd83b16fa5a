"""Pieces that several operators of this subpackage share: tokens, Arrow batches, durable tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: bytes.lower() changes A-Z only; every byte that is no digit, letter or part of a non-ASCII character becomes a space.
ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


def letter_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none."""
    return (text or "").encode().translate(ALNUM).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; null has none."""
    return (text or "").encode().lower().split()


def map_batches(df: DataFrame, schema: str, work: Callable[[], Callable], rows: int = 1000) -> DataFrame:
    """``work()`` runs once in a task and gives a function from a RecordBatch of at most ``rows`` rows to a dict of columns."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        do = work()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = do(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def check_id(id_col: str, results: str) -> None:
    """Raises if the id bears the name of a result column (names differ in more than case)."""
    if id_col.lower() in {x.strip().split(" ")[0].lower() for x in results.split(",")}:
        raise ValueError(f"the id column {id_col!r} has the name of a result column; rename it first")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a temporary folder serves a local session, whose executor is
    the driver; on a cluster this raises, for no folder of one machine is shared."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder; smaller on disk than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_to_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``right`` (one row a key) joined to ``left``, whose keys may be hot.

    Keys with over a thousandth of the rows, fewer than a thousand by that, are broadcast; the others are shuffled.
    """
    counts = left.groupBy(key).count()
    hot = written(counts.where(F.col("count") > F.lit(left.count() / 1000)).select(key))
    spread = left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key)
    return spread.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))
