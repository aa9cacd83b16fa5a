"""Importance resampling towards a target distribution, with a dictionary of distinct features.

Features are the runs of one to ``n`` consecutive words. Strings are counted once over the corpus, and only the distinct
strings are hashed into buckets; a bucket's gain compares the target's share with the corpus's. Gains are joined back to the
counts of each document, whose weight is their sum. A draw of a share of the documents without replacement takes the highest
weights with Gumbel noise from a hash of the id.

How it scales: documents are read once, in blocks of some ``BLOCK`` words. A block is written as its own list of distinct features with
counts, and each document as places in that list, so a frequent word costs one row a block and not one a document. The
dictionary is a sum over the blocks' lists. Features in more than a thousandth of all rows of the lists (fewer than a thousand
of them by that) meet their gains by a broadcast, the rest by a shuffled join; a block's gains then meet its documents in a group of
bounded size. Ranks come from one sort by ranges: places within ranges plus the sizes of the ranges before.

Defined results: null and empty texts have no features, weight 0 and no rank; a text of any length is read whole (in a block
of its own if it is longer than one); repeated rows each count and get their row; equal scores go to the smaller id, null ids
last, and repeated rows in any order; a null id draws as the empty text; an empty corpus gives no rows, an empty target counts as zero everywhere;
other columns are not read, so their names cannot clash; an id column with the name of a result column raises.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.llm.common import check_id, letter_words, written

BLOCK = 1_000_000
RESULTS = "n_features long, n_words long, weight long, score long, rank long"


def features(words: list[bytes], n: int) -> list[bytes]:
    """All runs of one to ``n`` words, joined by one space."""
    return [*words, *(b" ".join(words[i : i + k]) for k in range(2, n + 1) for i in range(len(words) - k + 1))]


def packed(places: np.ndarray, counts: np.ndarray, packer) -> bytes:
    """Distances between rising places, and counts, each in as many bytes as their largest needs."""
    order = np.argsort(places)
    arrays = (np.diff(places[order], prepend=0), counts[order])
    wide = [1 if (top := int(x.max(initial=0))) < 1 << 8 else 2 if top < 1 << 16 else 4 for x in arrays]
    return packer.compress(bytes(wide) + b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip(arrays, wide, strict=True)))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    n = (len(raw) - 2) // (raw[0] + raw[1])
    steps = np.frombuffer(raw, f"<u{raw[0]}", n, 2)
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(raw, f"<u{raw[1]}", n, 2 + n * raw[0]).astype(np.int64)


def blocks(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Two kinds of rows. A document: block, id, its numbers of words and features, its places with their counts, packed. A feature: block, place, feature,
    count in the block. Block numbers hold only within a written table."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, id {kind}, n_words long, n_features long, places binary, place int, feature string, count long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        total: list[int] = []
        rows: list[tuple] = []
        size = 0
        packer = zstandard.ZstdCompressor(level=1)

        def close():
            feats = list(known)
            blank, m, k = [None], len(rows), len(feats)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            data = [[number] * (m + k), *([*c, *blank * k] for c in columns), [*blank * m, *range(k)], [*blank * m, *(f.decode() for f in feats)], [*blank * m, *total]]
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, arrow, strict=True)], schema=arrow)
            known.clear(), total.clear(), rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = letter_words(text)
                    if rows and size + len(words) > BLOCK:
                        yield close()
                        number, size = number + 1, 0
                    size += len(words)
                    counted = Counter(features(words, n))
                    places = [known.setdefault(f, len(known)) for f in counted]
                    total.extend([0] * (len(known) - len(total)))
                    for p, c in zip(places, counted.values(), strict=True):
                        total[p] += c
                    rows.append((key, len(words), counted.total(), packed(np.array(places, np.int64), np.array(list(counted.values()), np.int64), packer)))
        if rows:
            yield close()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def dictionary(made: DataFrame, buckets: int) -> DataFrame:
    """feature, count, lists (blocks that hold it), bucket: every distinct string once."""
    counted = made.where("feature is not null").groupBy("feature").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("lists"))
    return counted.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    sums = lambda d, name: d.groupBy("bucket").agg(F.sum("count").alias(name))
    each = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = each.join(sums(corpus, "s"), "bucket", "left").join(sums(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1.0) * float(all_s + buckets) / ((F.col("s") + 1.0) * float(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(made: DataFrame, known: DataFrame, gains: DataFrame, kind: str) -> DataFrame:
    """id, n_words, n_features, weight of the documents of written blocks; ``known`` is their dictionary, ``gains`` has a row a bucket."""
    priced = known.join(F.broadcast(gains), "bucket").select("feature", "gain", "lists")
    rows = known.agg(F.sum("lists")).first()[0] or 0
    hot = F.col("lists") * 1000 > rows
    listed = made.where("feature is not null").select("block", "place", "feature")
    few = F.broadcast(priced.where(hot).drop("lists"))
    # one pass: the frequent ones are tagged by the broadcast, the others go on to the shuffled join
    tagged = listed.join(few, "feature", "left")
    found = tagged.where("gain is not null").select("block", "place", "gain")
    found = found.unionByName(tagged.where("gain is null").drop("gain").join(priced.where(~hot), "feature").select("block", "place", "gain"))
    schema = f"id {kind}, n_words long, n_features long, weight long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def add(docs: pa.Table, own: pa.Table) -> pa.Table:
        gain = np.zeros(own.num_rows, np.int64)
        gain[own.column("place").to_numpy()] = own.column("gain").to_numpy()
        weight = [int(gain[p] @ c) for p, c in (unpacked(x.as_py()) for x in docs.column("places"))]
        return pa.Table.from_arrays([docs.column("id").cast(arrow.field("id").type), docs.column("n_words"), docs.column("n_features"), pa.chunked_array([pa.array(weight, pa.int64())])], schema=arrow)

    texts = made.where("n_words is not null").select("block", "id", "n_words", "n_features", "places")
    return texts.groupBy("block").cogroup(found.select(F.col("block").alias("own"), "place", "gain").groupBy("own")).applyInArrow(add, schema)


def noise(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the first 32 bits of the SHA-256 of ``seed:id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, id_col: str, rows: int) -> DataFrame:
    """``scored`` (a written table) with ``place``, 1 for the highest score: one sort by ranges; only their sizes are summed."""
    parts = max(1, min(rows // 20_000, 10_000))
    order = [F.desc("score"), F.asc_nulls_last(id_col)]
    inside = written(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted(inside.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    before = dict(zip([part for part, _ in sizes], accumulate([0, *(n for _, n in sizes)]), strict=False))
    offsets = scored.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return inside.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + low + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """id, n_features, n_words, weight, score, rank. Of the documents with ``least_words`` words the highest ``percent`` of a
    hundred scores have a rank, from 1; the others' is null."""
    check_id(id_col, RESULTS)
    kind = docs.schema[id_col].dataType.simpleString()
    made = written(blocks(docs, id_col, text_col, n))
    known = written(dictionary(made, buckets))
    wanted = dictionary(blocks(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", n), buckets)
    gains = written(bucket_gains(known, wanted, buckets))
    told = weights(made, known, gains, kind).withColumnRenamed("id", id_col)
    scored = written(told.withColumn("score", F.col("weight") + noise(id_col, seed)))
    able = F.col("n_words") >= least_words
    many = scored.where(able).count()
    first = ranked(scored.where(able), id_col, many).withColumn("rank", F.when(F.col("place") <= percent * many // 100, F.col("place"))).drop("place")
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select(id_col, "n_features", "n_words", "weight", "score", "rank")
