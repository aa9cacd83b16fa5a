"""Language-model scores by deleted interpolation.

P(w|h) = l2 c(h,w)/c(h) + l1 c(w)/N + l0/(V+1), with weights l for each bucket of c(h) by powers of two. The weights
are learned by expectation-maximisation on held-out counts: one fold of the training documents is deleted from the
counts and its tokens are predicted from the rest. Counts cover all training documents.

The order is two: a context is the word before. The weights see the probabilities of the deleted fold rounded to half
powers of two, so that their histogram has a bounded size; it is the only thing that reaches the driver besides N and V.

How it runs. Tokens are packed into blocks, written as a table: document ids, token numbers and the 64-bit hashes of the
block's distinct words. Counts are exchanged in levels. On each level up to ``1 << FAN_BITS`` nodes (blocks at first) form a
group; each sends its sorted distinct keys with their counts, cut into as many ranges of hash, and the group's sums of one
range are a node of the next level. So a node is about as large on every level, rows are sent in proportion to the
blocks and the levels (their logarithm), and a hot word or pair arrives at most once a node. On the last level the sums
are totals; they go back the same way, aligned with the keys that came, and each block scores its documents.

Defined results: a null or empty text has one token, its end; words that hash alike (64 bits) would count as one;
with no training token every word is unknown; rows repeated are counted as often; an empty table gives no rows; columns
other than id and text are not read, so their names cannot clash; an id column with the name of a result column raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.llm.common import check_id, map_batches, remainder, spaced_words, written

FOLDS, TEST_FOLD, DELETED_FOLD = 7, 2, 3
BLOCK_TOKENS, FAN_BITS = 1_000_000, 8
END = xxhash.xxh64_intdigest(b" end", 0)  # no word holds a space
START = xxhash.xxh64_intdigest(b" start", 0)
CONTEXT_BUCKETS, STEP, LEVELS = 40, 2, 80


@dataclass(frozen=True)
class Model:
    train_tokens: int
    distinct: int
    weights: np.ndarray  # by bucket of c(h): of pair, word, uniform


def planes(values: np.ndarray) -> bytes:
    """Compressed: the bytes of equal significance stand together."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(32)))
        k = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return k ^ (k >> np.uint64(29))


def blocks(docs: DataFrame, id_col: str, text_col: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a block: ids, folds and token counts of its documents, token numbers, hashes of its words."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, folds array<int>, lengths array<int>, train_tokens long, n_tokens long, words binary, tokens binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, folds, lengths, chunks, known = [], [], [], [], {}

        def row():
            tokens = np.concatenate(chunks)
            hashes = np.array([END, *(xxhash.xxh64_intdigest(w, 0) for w in known)], np.uint64)
            train = sum(n for n, f in zip(lengths, folds, strict=True) if f != TEST_FOLD)
            return pa.RecordBatch.from_pylist([{"block": (part << 20) + number, "ids": ids, "folds": folds, "lengths": lengths, "train_tokens": train, "n_tokens": len(tokens), "words": planes(hashes), "tokens": planes(tokens)}], schema=arrow)

        held = 0
        for batch in batches:
            for key, fold, text in zip(batch.column("id").to_pylist(), batch.column("fold").to_pylist(), batch.column("text"), strict=True):
                words = spaced_words(text.as_py())
                chunks.append(np.array([known.setdefault(w, len(known) + 1) for w in words] + [0], np.uint32))
                ids.append(key)
                folds.append(fold)
                lengths.append(len(words) + 1)
                held += len(words) + 1
                if held >= block_tokens:
                    yield row()
                    ids, folds, lengths, chunks, known, held, number = [], [], [], [], {}, 0, number + 1
        if held:
            yield row()

    return written(docs.select(F.col(id_col).alias("id"), remainder(F.col(id_col), FOLDS).cast("int").alias("fold"), F.col(text_col).alias("text")).mapInArrow(pack, schema))


def unpack(row: dict):
    """Word hashes; token numbers; the token before each (-1: start); folds by token; document bounds."""
    words, tokens = unplanes(row["words"], np.uint64), unplanes(row["tokens"], np.uint32).astype(np.int64)
    lengths = np.array(row["lengths"])
    first = np.cumsum(lengths) - lengths
    before = np.concatenate([[-1], tokens[:-1]])
    before[first] = -1
    return words, tokens, before, np.repeat(np.array(row["folds"]), lengths), first


def token_pairs(words: np.ndarray, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    left = np.where(before < 0, np.uint64(START), words[before])
    return pair_keys(left, words[tokens])


def _sorted_counts(keys: np.ndarray, fold: np.ndarray):
    """Distinct sorted keys and how often they stand in training and in the deleted fold."""
    order = np.argsort(keys, kind="stable")
    keys, fold = keys[order], fold[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(fold != TEST_FOLD, start, dtype=np.int64), np.add.reduceat(fold == DELETED_FOLD, start, dtype=np.int64)


PIECE = "kind int, node long, range long, sub int, keys binary, train binary, deleted binary"
TOTAL = "kind int, node long, range long, sub int, train binary, deleted binary, distinct long"


def _cut(keys: np.ndarray, level: int, bits: int):
    """(number, first, end) of the ranges of sorted keys by the level's bits; keys agree in the bits before."""
    sub = (keys << np.uint64(level * bits)) >> np.uint64(64 - bits)
    heads = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return zip(sub[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True)


def _pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def _send(table: DataFrame, bits: int) -> DataFrame:
    """The pieces of the blocks: distinct words (kind 0) and pairs (1) with their counts, by ranges of hash."""
    def work():
        def do(batch):
            out = {k: [] for k in ("kind", "node", "range", "sub", "keys", "train", "deleted")}
            for row in batch.to_pylist():
                words, tokens, before, fold, _ = unpack(row)
                for kind, keys in ((0, words[tokens]), (1, token_pairs(words, tokens, before))):
                    keys, train, deleted = _sorted_counts(keys, fold)
                    for sub, a, b in _cut(keys, 0, bits):
                        for name, x in zip(out, (kind, row["block"], 0, sub, _pack_keys(keys[a:b]), planes(train[a:b]), planes(deleted[a:b])), strict=True):
                            out[name].append(x)
            return out

        return do

    return map_batches(table, PIECE, work, rows=1)


def _summed(pdf):
    """The distinct keys of some pieces, where each piece's keys stand in them, and the sums."""
    keys = [_unpack_keys(x) for x in pdf["keys"]]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([unplanes(x, np.int64) for x in pdf[c]])).astype(np.int64) for c in ("train", "deleted")]
    return distinct, np.split(where, np.cumsum([len(k) for k in keys])[:-1]), sums


def _total(pdf):
    """Totals of one range, aligned with the keys of each piece; distinct: keys in training, told once."""
    import pandas as pd

    _, where, sums = _summed(pdf)
    back = {c: [planes(s[w]) for w in where] for c, s in zip(("train", "deleted"), sums, strict=True)}
    return pd.DataFrame({c: pdf[c] for c in ("kind", "node", "range", "sub")} | back | {"distinct": [int((sums[0] > 0).sum())] + [0] * (len(pdf) - 1)})


def _exchange(pieces: DataFrame, groups: int, level: int, bits: int) -> DataFrame:
    """Totals over all nodes for the keys of every piece, by levels of groups."""
    if groups <= 1:
        return pieces.groupBy("kind", "range", "sub").applyInPandas(_total, TOTAL)
    pieces = written(pieces.withColumn("up", F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(groups))).withColumn("wide", F.col("range") * (1 << bits) + F.col("sub")))
    place = ["kind", "up", "wide"]

    def merge(key, pdf):
        import pandas as pd

        keys, _, sums = _summed(pdf)
        return pd.DataFrame({"kind": [key[0]], "up": [key[1]], "wide": [key[2]], "keys": [_pack_keys(keys)], "train": [planes(sums[0])], "deleted": [planes(sums[1])]})

    merged = written(pieces.groupBy(*place).applyInPandas(merge, "kind int, up long, wide long, keys binary, train binary, deleted binary"))

    def again():
        def do(batch):
            out = {k: [] for k in ("kind", "node", "range", "sub", "keys", "train", "deleted")}
            for row in batch.to_pylist():
                keys, train, deleted = _unpack_keys(row["keys"]), unplanes(row["train"], np.int64), unplanes(row["deleted"], np.int64)
                for sub, a, b in _cut(keys, level + 1, bits):
                    for name, x in zip(out, (row["kind"], row["up"], row["wide"], sub, _pack_keys(keys[a:b]), planes(train[a:b]), planes(deleted[a:b])), strict=True):
                        out[name].append(x)
            return out

        return do

    above = _exchange(map_batches(merged, PIECE, again, rows=8), -(-groups >> bits), level + 1, bits)
    parts = above.groupBy("kind", F.col("node").alias("up"), F.col("range").alias("wide")).agg(F.array_sort(F.collect_list(F.struct("sub", "train", "deleted"))).alias("parts"), F.sum("distinct").alias("distinct"))
    known = merged.select(*place, F.col("keys").alias("known")).join(parts, place)

    def back(left, right):
        import pandas as pd

        known, parts = _unpack_keys(right["known"].iloc[0]), right["parts"].iloc[0]
        totals = {c: np.concatenate([unplanes(p[c], np.int64) for p in parts]) for c in ("train", "deleted")}
        at = [np.searchsorted(known, _unpack_keys(x)) for x in left["keys"]]
        return pd.DataFrame({c: left[c] for c in ("kind", "node", "range", "sub")} | {c: [planes(x[w]) for w in at] for c, x in totals.items()} | {"distinct": [int(right["distinct"].iloc[0])] + [0] * (len(left) - 1)})

    return pieces.groupBy(*place).cogroup(known.groupBy(*place)).applyInPandas(back, TOTAL)


def corpus_counts(table: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """(kind, node, range, sub, train, deleted, distinct): totals over the corpus for the keys of every block."""
    return written(_exchange(_send(table, bits), -(-table.count() >> bits), 0, bits))


def _gathered(table: DataFrame, counts: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("kind", "sub", "train", "deleted"))).alias("parts")
    return table.join(counts.groupBy(F.col("node").alias("block")).agg(parts), "block")


def _lookup(row: dict, only: int | None = None):
    """For the tokens (of fold ``only``): training and deleted counts of the pair, of the word before, and of the word."""
    words, tokens, before, fold, first = unpack(row)
    total = {kind: [np.concatenate([unplanes(p[c], np.int64) for p in row["parts"] if p["kind"] == kind]) for c in ("train", "deleted")] for kind in (0, 1)}
    place = np.searchsorted(np.sort(words), words)  # each word of a block stands in it, but for an end of no document
    by_word = [sums[place] for sums in total[0]]
    pairs = token_pairs(words, tokens, before)
    distinct = np.unique(pairs)
    if only is not None:
        pick = fold == only
        tokens, before, pairs = tokens[pick], before[pick], pairs[pick]
    where = np.searchsorted(distinct, pairs)
    # every word is followed by one token, so its count as a context is its own; a start stands where an end does
    context = np.where(before < 0, 0, before)
    return [s[where] for s in total[1]], [b[context] for b in by_word], [b[tokens] for b in by_word], first


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + floor(log2)."""
    return np.minimum(CONTEXT_BUCKETS - 1, np.frexp(context.astype(float))[1]).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for p = 0, else by powers of two in STEP steps each."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(1 + np.round(-STEP * np.log2(np.maximum(p, 1e-300))), 1, LEVELS - 1), 0).astype(np.int64)


def learn_weights(table: DataFrame, counts: DataFrame, train_tokens: int, distinct: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket of context count, from the deleted fold's tokens and the counts without it."""
    deleted_tokens = table.select(F.sum(F.expr(f"aggregate(zip_with(folds, lengths, (f, n) -> IF(f = {DELETED_FOLD}, n, 0)), 0L, (a, x) -> a + x)"))).first()[0] or 0

    def work():
        def do(batch):
            cells = np.zeros(CONTEXT_BUCKETS * LEVELS * LEVELS, np.int64)
            for row in batch.to_pylist():
                pair, context, word, _ = _lookup(row, DELETED_FOLD)
                c2, ch, c1 = (x[0] - x[1] for x in (pair, context, word))
                p2, p1 = c2 / np.maximum(ch, 1), c1 / max(1, train_tokens - deleted_tokens)
                cells += np.bincount((_bucket(ch) * LEVELS + _level(p2)) * LEVELS + _level(p1), minlength=len(cells))
            cell = np.flatnonzero(cells)
            return {"cell": cell, "n": cells[cell]}

        return do

    # at most CONTEXT_BUCKETS * LEVELS * LEVELS cells
    cells = map_batches(_gathered(table, counts), "cell int, n long", work, rows=1).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    if not cells:
        return weights
    cell, n = np.array([r["cell"] for r in cells]), np.array([r["n"] for r in cells], float)
    back = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / STEP), 0.0)
    p = np.stack([back(cell // LEVELS % LEVELS), back(cell % LEVELS), np.full(len(cell), 1 / (distinct + 1))], 1)
    bucket = cell // (LEVELS * LEVELS)
    for b in range(CONTEXT_BUCKETS):
        own = bucket == b
        if own.any():
            weights[b] = expectation_maximisation(p[own], n[own], weights[b], rounds)
        elif b > 1:
            weights[b] = weights[b - 1]
    return weights


def expectation_maximisation(p: np.ndarray, n: np.ndarray, weights: np.ndarray, rounds: int) -> np.ndarray:
    """Mixture weights that raise the likelihood of n events with component probabilities p, round by round."""
    for _ in range(rounds):
        share = p * weights
        weights = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
    return np.maximum(weights, [0, 0, 1e-6]) / np.maximum(weights, [0, 0, 1e-6]).sum()


def fit(table: DataFrame, bits: int = FAN_BITS) -> tuple[Model, DataFrame]:
    train = table.agg(F.sum("train_tokens")).first()[0]
    counts = corpus_counts(table, bits)
    distinct = counts.where("kind = 0").agg(F.sum("distinct")).first()[0] or 0
    return Model(train or 0, distinct, learn_weights(table, counts, train or 0, distinct)), counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bits: int = FAN_BITS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both sums of log10."""
    check_id(id_col, "held_out, n_tokens, n_known, train_tokens, base_score, score")
    table = blocks(docs, id_col, text_col, block_tokens)
    model, counts = fit(table, bits)
    kind = docs.schema[id_col].dataType.simpleString()

    def work():
        def do(batch):
            (row,) = batch.to_pylist()
            pair, context, word, first = _lookup(row)
            p2, p1 = pair[0] / np.maximum(context[0], 1), word[0] / max(1, model.train_tokens)
            w = model.weights[_bucket(context[0])]
            p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (model.distinct + 1)
            base = np.log10((word[0] + 1) / (model.train_tokens + model.distinct + 1))
            sums = lambda x: np.add.reduceat(x, first)
            return {
                "id": row["ids"],
                "held_out": [f == TEST_FOLD for f in row["folds"]],
                "n_tokens": row["lengths"],
                "n_known": sums((word[0] > 0).astype(np.int64)),
                "train_tokens": [model.train_tokens] * len(first),
                "base_score": sums(base),
                "score": sums(np.log10(p)),
            }

        return do

    return map_batches(_gathered(table, counts), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", work, rows=1).withColumnRenamed("id", id_col)
