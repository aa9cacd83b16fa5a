"""SimHash near-dedup with Golay-code fuzzy hashing.

A text's fingerprint has 64 bits, by majority over XXH64 (seed 42) of its word shingles. Equal fingerprints are one
node; nodes link at ``LIMIT`` = 4 or fewer differing bits. The fingerprint is cut into segments A, B, C of 22, 21 and 21
bits. Four errors leave one segment untouched, or all of A, B and C with one or two errors:

* one segment is untouched and another has at most two errors: they share the untouched segment and a Golay key of the
  other, in one of six families;
* no segment is untouched: then A and B have at most two errors each, and share a Golay key of A and of B.

So every link shares a key. Nodes are sorted by key within partitions and each run of equal keys is verified; a run gives
links that connect what is connected in it, not all pairs. Runs over ``BLOCK`` nodes are cut into blocks, and the pairs of
blocks are verified apart: exact, with bounded memory.
Components come from iterated minima over the links (``components``); nothing of it passes through the driver.

Defined results: null and empty texts have fingerprint 0 and link like any other; a component's id is its smallest
doc_id that isn't null (null if all are); repeated rows each get their row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import golay
from weftline.llm.common import fresh, join_to_many, map_batches, spaced_words, written

LIMIT, BLOCK, SMALL = 4, 8192, 8
SHIFT, WIDE = (42, 21, 0), (22, 21, 21)


def fingerprint(text: str | None, width: int = 4) -> int:
    words = spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
    over = sum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for part in np.array_split(hashes, -(-n // 16384)))
    return int(np.packbits(over * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work():
        def do(batch):
            prints = np.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], np.uint64)
            return {"id": batch.column("id"), "fp": prints.view(np.int64)}

        return do

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, fp long", work)


def index_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each print (uint64), and the row of the print each belongs to."""
    part = [(prints >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(SHIFT, WIDE, strict=True)]
    code = [_six(golay.keys(p)) for p in part]
    out = [(np.uint64(2 + f) << np.uint64(40)) | (part[a][:, None] << np.uint64(12)) | code[b] for f, (a, b) in enumerate((a, b) for a in range(3) for b in range(3) if a != b)]
    both = (np.uint64(1) << np.uint64(40)) | (code[0][:, :, None] << np.uint64(12)) | code[1][:, None, :]
    made = np.sort(np.concatenate([*out, both.reshape(len(prints), 36)], 1), axis=1)
    new = np.ones(made.shape, bool)
    new[:, 1:] = made[:, 1:] != made[:, :-1]
    return made[new], np.nonzero(new)[0]


def _six(codes: np.ndarray) -> np.ndarray:
    """The distinct values of each row, at most six, in six columns; the smallest fills what is left."""
    codes = np.sort(codes, axis=1)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    out = np.repeat(codes[:, :1], 6, 1)
    rows, cols = np.nonzero(new)
    out[rows, (new.cumsum(1) - 1)[rows, cols]] = codes[rows, cols]
    return out.astype(np.uint64)


def near(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= LIMIT


def connect(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected in a run of distinct prints: fewer than there are prints."""
    rest, links = np.sort(values), []
    while len(rest) > 1:
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            x = ahead.pop()
            hit = near(rest, x)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                links += [(int(x), int(y)) for y in found]
                ahead += list(found)
    return links


def run_links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links (two columns) within the runs of sorted keys; each run holds distinct prints."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    found = []
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, SMALL):
        i = np.flatnonzero(small[:-shift] & (key[shift:] == key[:-shift])) if len(key) > shift else np.zeros(0, int)
        i = i[near(fp[i], fp[i + shift])]
        found.append(np.stack([fp[i], fp[i + shift]], 1))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        if links := connect(fp[s : s + n]):
            found.append(np.array(links, np.uint64))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def links(nodes: DataFrame, parts: int) -> DataFrame:
    """(a, b) between distinct prints: every linked pair is connected through these."""
    def emit():
        def do(batch):
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key, owner = index_keys(fp)
            return {"key": key.view(np.int64), "fp": fp[owner].view(np.int64)}

        return do

    keyed = map_batches(nodes.select("fp"), "key long, fp long", emit, rows=4096)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("prints", pa.binary())])

    def pack(pairs: np.ndarray, blocks: list[tuple[int, int, bytes]]):
        pairs = pairs.astype(np.uint64).view(np.int64).reshape(-1, 2)
        k = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array(list(pairs[:, 0]) + [None] * k, pa.int64()), pa.array(list(pairs[:, 1]) + [None] * k, pa.int64()), *(pa.array([None] * len(pairs) + [x[i] for x in blocks], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary())))], schema=schema)

    def verify(batches):
        key, fp, block = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0

        def flush(key, fp, block, last):
            """Verifies whole runs; the last run, if it may go on, is held back or, from BLOCK prints, set down as a block."""
            blocks, hold = [], len(key)
            if len(key) and not last:
                hold = int(np.searchsorted(key, key[-1]))
            done = run_links(key[:hold], fp[:hold]) if hold else np.zeros((0, 2), np.uint64)
            rest_key, rest_fp = key[hold:], fp[hold:]
            if block and hold:  # the run that began in earlier blocks ends here
                end = int(np.searchsorted(key, key[0], "right"))
                blocks.append((int(key[0]), block, fp[:end].tobytes()))
                block = 0
            while len(rest_key) >= BLOCK:
                part = rest_fp[:BLOCK]
                done = np.concatenate([done, np.array(connect(part), np.uint64).reshape(-1, 2)])
                blocks.append((int(rest_key[0]), block, part.tobytes()))
                block += 1
                rest_key, rest_fp = rest_key[BLOCK:], rest_fp[BLOCK:]
            return done, blocks, rest_key, rest_fp, block

        open_key = None
        for batch in batches:
            new = batch.column("key").to_numpy(zero_copy_only=False)
            if block and not len(key) and len(new) and new[0] != open_key:
                block = 0  # the run ended with a full block
            key = np.concatenate([key, new])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key):
                open_key = key[-1]
            done, blocks, key, fp, block = flush(key, fp, block, False)
            yield pack(done, blocks)
        done, blocks, *_ = flush(key, fp, block, True)
        yield pack(done, blocks)

    checked = keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(verify, "a long, b long, key long, block int, prints binary")
    checked = written(checked)
    direct = checked.where("key is null").select("a", "b")
    blocks = checked.where("key is not null").select("key", "block", "prints")

    def across():
        def do(batch):
            pairs = zip(batch.column("prints").to_pylist(), batch.column("other").to_pylist(), strict=True)
            found = [connect(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])) for x, y in pairs]
            got = np.array([x for links in found for x in links], np.uint64).reshape(-1, 2).view(np.int64)
            return {"a": got[:, 0], "b": got[:, 1]}

        return do

    second = blocks.select(F.col("key"), F.col("block").alias("to"), F.col("prints").alias("other"))
    crossed = map_batches(blocks.join(second, "key").where("block < to").select("prints", "other"), "a long, b long", across, rows=4)
    return direct.union(crossed)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the smallest node of its component.

    Alternating minima: every node's larger neighbours are tied to the smallest node it sees, then its smaller ones, until
    nothing changes; the rounds grow with the logarithm of the component's length. Hot nodes are summed before they are
    shuffled and their joins are between slim rows, where Spark splits skewed partitions.
    """
    tied = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = tied.union(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        tied = written(small)
        now = tied.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return tied.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tied.select(F.col("v"), F.col("v")).distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp, component, root): one row per document; root is the smallest fingerprint of the component."""
    prints = written(fingerprints(docs, id_col, text_col, width))
    return join_to_many(prints, _known(prints), "fp").select("id", "fp", F.col("first.id").alias("component"), "root")


def _known(prints: DataFrame) -> DataFrame:
    """(fp, root, first) of each distinct print; first: the first row of its component, by id (null last), then print."""
    nodes = written(prints.groupBy("fp").agg(F.min(_place("id", "fp")).alias("first")))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // 100_000)
    roots = components(links(nodes, parts))
    known = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    firsts = known.groupBy("root").agg(F.min("first").alias("first"))
    return written(join_to_many(known.drop("first"), firsts, "root"))


def _place(id_col: str, print_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col(print_col).alias("print"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row of each group stays: the one with the smallest id (null last), of texts under one id the one with the
    smallest fingerprint, of rows equal in both any one. Texts of different groups stay, whatever their ids."""
    prints = written(fingerprints(docs, id_col, text_col, width))
    firsts = _known(prints).select("first.id", "first.print").distinct()
    return keep_rows(docs, prints.select("id", F.col("fp").alias("print")), firsts, id_col, text_col, lambda texts: np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64))


def keep_rows(docs: DataFrame, found: DataFrame, firsts: DataFrame, id_col: str, text_col: str, print_of: Callable) -> DataFrame:
    """The rows of ``docs`` whose (id, print) is in ``firsts``, one row for each. ``found``: (id, print) of all rows.

    Rows go by id where an id has one row. Prints are made again, by ``print_of`` (a list of texts to longs), only for
    the rows of repeated and null ids, so that no text is shuffled for the others.
    """
    one = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["print"] == b["print"])
    lost = written(found.join(firsts, one(found, firsts), "left_anti").distinct())
    odd = written(found.groupBy("id").count().where("count > 1 or id is null").select("id"))
    i, p = fresh(docs, "_odd_id"), fresh(docs, "_odd_print")
    gone = lost.where("id is not null").join(odd, "id", "left_anti").select(F.col("id").alias(i)).distinct()
    rest = docs.join(gone, docs[id_col] == gone[i], "left_anti")
    if odd.isEmpty():
        return rest
    named = odd.select(F.col("id").alias(i))
    is_odd = rest[id_col].eqNullSafe(named[i])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def told(batches):
        for batch in batches:
            yield batch.append_column(p, pa.array(print_of(batch.column(text_col).to_pylist()), pa.int64()))

    again = rest.join(named, is_odd, "left_semi").mapInArrow(told, f"{schema}, `{p}` long")
    again = again.join(lost, again[id_col].eqNullSafe(lost["id"]) & (again[p] == lost["print"]), "left_anti").dropDuplicates([id_col, p])
    return rest.join(named, is_odd, "left_anti").unionByName(again.drop(p))
