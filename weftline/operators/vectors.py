"""Exact nearest neighbours by cosine: stated queries against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 20_000) -> DataFrame:
    """(query, found, sim, place): the k rows of highest cosine to each query, itself left out; ties by id.

    Queries are packed into matrices of ``block`` rows at most, and each partition of the rows meets one matrix at a
    time: it keeps k rows a query, so what is shuffled is k a query and partition. Zero vectors have no neighbours.
    """
    told = queries.where(F.col(vector).isNotNull())
    packs = told.groupBy(F.pmod(F.xxhash64(key), F.lit(max(1, -(-told.count() // block)))).alias("_part")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))).alias("q"))
    # a pack in several pieces once it passes ``block``
    packs = packs.select(F.explode(F.expr(f"transform(sequence(0, (size(q) - 1) div {block}), i -> slice(q, i * {block} + 1, {block}))")).alias("q"))
    spark, out = rows.sparkSession, None
    # a block at a time is on the driver
    matrix = ((np.array([x["id"] for x in r["q"]], np.int64), _unit(np.array([x["v"] for x in r["q"]], np.float64))) for r in packs.toLocalIterator())
    slim = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    for pack in _joined(matrix, block):
        sent = spark.sparkContext.broadcast(pack)  # at most ``block`` vectors

        def best(batches, sent=sent):
            ids, q = sent.value
            top_s, top_i = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    own = part.column("id").to_numpy(zero_copy_only=False)
                    v = _unit(np.array(part.column("v").to_pylist(), np.float64))
                    s = np.round(q @ v.T, 6)
                    s[(ids[:, None] == own[None, :]) | np.isnan(s)] = -np.inf
                    top_s, top_i = np.concatenate([top_s, s], 1), np.concatenate([top_i, np.broadcast_to(own, s.shape)], 1)
                    order = np.lexsort((top_i, -top_s))[:, :k]
                    top_s, top_i = np.take_along_axis(top_s, order, 1), np.take_along_axis(top_i, order, 1)
            real = top_s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(top_i[real]), pa.array(top_s[real])], names=["query", "found", "sim"])

        found = slim.mapInArrow(best, "query long, found long, sim double")
        out = found if out is None else out.union(found)
    if out is None:
        out = slim.select(F.col("id").alias("query"), F.col("id").alias("found"), F.lit(0.0).alias("sim")).where("false")
    ranked = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("found").alias("f")))), 1, k).alias("top"))
    return ranked.select("query", F.posexplode("top").alias("p", "t")).select("query", F.col("t.f").alias("found"), (-F.col("t.d")).alias("sim"), (F.col("p") + 1).alias("place"))


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(1, keepdims=True)) if len(v) else v


def _joined(packs, block: int):
    ids, vs, n = [], [], 0
    for i, v in packs:
        if n + len(i) > block and ids:
            yield np.concatenate(ids), np.concatenate(vs)
            ids, vs, n = [], [], 0
        ids.append(i)
        vs.append(v)
        n += len(i)
    if ids:
        yield np.concatenate(ids), np.concatenate(vs)
