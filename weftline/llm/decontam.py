"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, each text scanned once.

Texts and items are normalised to their words (``letter_words``) with one space on either side of each; an item's
windows are its runs of ``width`` words, or all its words if it has fewer. A document word inside an occurrence of a
window is hit. Offsets into the normalised text lead back to words and, for ``spans``, to code points of the original.

The automaton goes to every task, so its size is checked: items are taken in shards of at most ``shard_words`` words,
each shard has an automaton of its own, and the documents are scanned once a shard. Only an item of more words than that
makes a larger one.

Defined results: null and empty texts have no words and no hits; items without a word are ignored; repeated items count
once; an item with a null id hits like any other, but stands in no list of items; rows repeated in the documents each get
their result; an empty benchmark hits nothing. Columns that aren't asked for are not read, and those kept may bear any
name but n_words, n_hit, items and spans.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ALNUM, fresh, letter_words, map_batches

_BUILT: dict[str, tuple] = {}


def item_windows(text: str | None, width: int) -> list[bytes]:
    words = letter_words(text)
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def automaton(items: list[tuple[str | None, str]], width: int):
    """The automaton over all windows, and each window's word count and items, but for null ids; None if there is no window."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in item_windows(text, width):
            owners.setdefault(window, set()).update([] if item is None else [item])
    built = ahocorasick.Automaton()
    for window, ids in owners.items():
        built.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(ids))))
    built.make_automaton()
    return built if owners else None


def scan(built, text: str | None):
    """Words, a flag a word, and the items with an occurrence."""
    words = letter_words(text)
    hit, items = None, set()
    if built is not None and words:
        spaced = b" " + b" ".join(words) + b" "
        starts = None
        for end, (n, ids) in built.iter(spaced.decode("latin-1")):
            if hit is None:
                hit, starts = np.zeros(len(words), bool), np.flatnonzero(np.frombuffer(spaced, np.uint8) == 0x20)
            last = int(np.searchsorted(starts, end))  # the space at the end follows word last - 1
            hit[last - n : last] = True
            items.update(ids)
    return len(words), hit, items


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last code point of each word."""
    coded = np.frombuffer(text.encode().translate(ALNUM), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], coded != 0x20, [False]]).astype(np.int8)))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
    return points[edges[::2]], points[edges[1::2]]


def _shards(items: DataFrame, shard_words: int):
    """Lists of (item id as text, text) of at most shard_words words: the rows come one at a time."""
    now, words = [], 0
    for item, text in items.toLocalIterator():
        n = len(letter_words(text))
        if n and words + n > shard_words and now:
            yield now
            now, words = [], 0
        if n:
            now.append((item, text))
            words += n
    yield now


def _sent(spark, shard: list[tuple[str, str]]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, shard))


def _built(sent, width: int):
    """The automaton of a broadcast shard, built once in each Python worker."""
    name, shard = sent.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = (automaton(shard, width),)
    return _BUILT[name][0]


def find_leaks(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, shard_words: int = 50_000, spans: bool = False) -> DataFrame:
    """The columns ``keep`` of the documents with n_words, n_hit, items (sorted ids) and, on request, spans (start, end)."""
    text, flags = fresh(docs, "_leak_text"), fresh(docs, "_leak_hits")
    df = docs.select(*keep, F.col(text_col).alias(text))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def scanned(df: DataFrame, shard: list[tuple[str, str]], first: bool, last: bool) -> DataFrame:
        sent = _sent(df.sparkSession, shard)

        def work():
            built = _built(sent, width)

            def do(batch):
                texts = batch.column(text).to_pylist()
                got = {c: batch.column(c) for c in keep} | {"n_words": [], "items": []}
                old_hits, old_items = ([None] * len(texts), [[]] * len(texts)) if first else (batch.column(flags).to_pylist(), batch.column("items").to_pylist())
                hits = []
                for x, before, known in zip(texts, old_hits, old_items, strict=True):
                    n, hit, found = scan(built, x)
                    if before:
                        seen = np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool)
                        hit = seen if hit is None else seen | hit
                    hits.append(hit)
                    got["n_words"].append(n)
                    got["items"].append(sorted(found.union(known)))
                if last:
                    got["n_hit"] = [0 if h is None else int(h.sum()) for h in hits]
                    got["spans"] = [[] if h is None else _merged(np.flatnonzero(h), x) for h, x in zip(hits, texts, strict=True)] if spans else []
                else:
                    got |= {text: batch.column(text), flags: [None if h is None else np.packbits(h).tobytes() for h in hits]}
                return got

            return do

        ends = ["n_hit long", *["spans array<struct<start:long,end:long>>"] * spans] if last else [f"`{text}` string", f"`{flags}` binary"]
        return map_batches(df, ", ".join([*kept, "n_words long", "items array<string>", *ends]), work)

    shards = _shards(_items(items, item_id, item_text), shard_words)
    now, first = next(shards), True
    for after in shards:  # two shards at a time are on the driver
        df = scanned(df, now, first, False)
        now, first = after, False
    return scanned(df, now, first, True)


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()


def _merged(hits: np.ndarray, text: str | None) -> list[dict]:
    if not len(hits):
        return []
    starts, ends = word_offsets(text)
    runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
    return [{"start": int(starts[r[0]]), "end": int(ends[r[-1]])} for r in runs]


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, shard_words: int = 50_000) -> DataFrame:
    """The documents without a word inside a benchmark window, with all their columns."""
    for shard in _shards(_items(items, item_id, item_text), shard_words):
        docs = _drop_shard(docs, shard, text_col, width)
    return docs


def _drop_shard(docs: DataFrame, shard: list[tuple[str, str]], text_col: str, width: int) -> DataFrame:
    sent = _sent(docs.sparkSession, shard)

    def clean(batches):
        built = _built(sent, width)
        for batch in batches:
            yield batch.filter(pa.array([scan(built, x.as_py())[1] is None for x in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
