"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every piece of the model that stands in it, and byte pieces for a character that no
piece covers. A piece's probability falls with its rank in the model (``(rank + 1) ** -theta``): the forward pass sums it
over all ways to a place, in logarithms, and the backward pass draws the last piece of each prefix in proportion. Draws come
from a hash of the row's key and the place in the text, so a row is segmented alike wherever and whenever it runs.

No piece has a space mark after another character, so every path passes the places before a word's space mark: the lattice
falls into chunks there. Texts, and parts of long ones, are taken in groups of about ``GROUP`` characters; equal chunks of a group share one forward
pass, and the passes of all its chunks run together, place by place, over arrays. Places that no piece crosses cut a chunk
further, so a long text without spaces is no long chain unless its pieces overlap throughout.

Decoding is lossless: a space mark that stands in the text itself is written in byte pieces, and the mark that encoding
puts in front is taken off again.

A piece's weight is a choice, for the model file holds ranks of merges and no probabilities; ``theta`` is a parameter.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; a null key counts as empty, so rows
that repeat in key and text are segmented alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

#: LITERAL stands for a mark of the text among the chunks: no chunk has a mark after another character.
MARK, LITERAL, GROUP, SEED, THETA = "▁", "x▁", 400_000, 20, 1.0


class Pieces:
    """The pieces of a model file: numbers, weights, bytes, and a trie over them."""

    COMMON = 128

    def __init__(self, model: bytes, theta: float = THETA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=model)
        size = model.get_piece_size()
        self.number, self.weight, self.bytes = {}, {}, [b""] * size
        self.byte_number = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_number[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and not re.search(f"[^{MARK}]{MARK}", piece):
                self.number[piece] = i
                self.weight[piece] = (1 - model.get_score(i)) ** -theta
                self.bytes[i] = piece.replace(MARK, " ").encode()
        self.least = float(size) ** -theta
        self.longest = max(map(len, self.number))
        self._trie()

    def _trie(self) -> None:
        """Node 0 is the root. Steps by the commonest characters stand in a table, the others in a sorted list."""
        nodes = {"": 0}
        steps = []
        for piece in self.number:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    steps.append((nodes[piece[: k - 1]], ord(piece[k - 1]), nodes[piece[:k]]))
        origin, char, target = np.array(steps, np.int64).T
        kinds, n = np.unique(char, return_counts=True)
        common = kinds[np.argsort(-n, kind="stable")[: self.COMMON - 1]]
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[common] = np.arange(1, len(common) + 1)
        self.table = np.full((len(nodes), self.COMMON), -1, np.int32)
        self.table[origin, self.kind[char]] = np.where(self.kind[char] > 0, target, -1)
        self.table[:, 0] = -1
        rare = self.kind[char] == 0
        key = origin[rare] << 21 | char[rare]
        order = np.argsort(key)
        self.rare, self.rare_target = np.append(key[order], 1 << 62), np.append(target[rare][order], -1)
        self.piece_at, self.log_at = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes))
        for piece, i in self.number.items():
            self.piece_at[nodes[piece]], self.log_at[nodes[piece]] = i, np.log(self.weight[piece])

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes below by these characters; -1 where there is none."""
        kind = self.kind[char]
        out = self.table[node, kind]
        odd = np.flatnonzero(kind == 0)
        if len(odd):
            key = node[odd].astype(np.int64) << 21 | char[odd]
            at = np.searchsorted(self.rare, key)
            out[odd] = np.where(self.rare[at] == key, self.rare_target[at], -1)
        return out


class Lattice:
    """The forward passes of many chunks. Chunk c has its places from base[c] to base[c] + size[c]."""

    def __init__(self, pieces: Pieces, found: list[str]):
        marks = np.array([c == LITERAL for c in found], bool)
        found = [MARK if c == LITERAL else c for c in found]
        self.size = np.fromiter(map(len, found), np.int64, len(found))
        self.base = np.cumsum(self.size + 1) - self.size - 1
        chars = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        chunk = np.repeat(np.arange(len(found), dtype=np.int32), self.size)
        places = int(len(chars) + len(found))
        # of a character: the place before it, and how many characters of its chunk are left
        place = np.arange(len(chars), dtype=np.int32) + chunk
        left = np.repeat((self.base + self.size).astype(np.int32), self.size) - place
        starts, ends, numbers, logs = [], [], [], []
        live, node = np.flatnonzero(~marks[chunk]).astype(np.int32), None
        node = np.zeros(len(live), np.int32)
        single = np.zeros(len(chars), bool)
        for length in range(1, pieces.longest + 1):
            inside = left[live] >= length
            live, node = live[inside], node[inside]
            node = pieces.step(node, chars[live + (length - 1)])
            on = node >= 0
            live, node = live[on], node[on]
            if not len(live):
                break
            number = pieces.piece_at[node]
            hit = number >= 0
            at = live[hit]
            if length == 1:
                single[at] = True
            starts.append(place[at])
            ends.append(place[at] + np.int32(length))
            numbers.append(number[hit])
            logs.append(pieces.log_at[node[hit]])
        bare = np.flatnonzero(~single)
        if len(bare):
            c = chars[bare]
            starts.append(place[bare])
            ends.append(place[bare] + np.int32(1))
            numbers.append(-c - 1)
            logs.append(np.log(pieces.least) * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        start, end, number, log = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((starts, np.int32), (ends, np.int32), (numbers, np.int32), (logs, float)))
        order = np.argsort(end, kind="stable")
        self.start, end, self.number, log = start[order], end[order], number[order], log[order]
        self.share = self._shares(places, end, log)
        self.first = np.searchsorted(end, np.arange(places + 1, dtype=np.int32)).astype(np.int32)

    def _shares(self, places: int, end: np.ndarray, log: np.ndarray) -> np.ndarray:
        """For each edge, sorted by its end: the summed share of the edges to this end, itself included."""
        long = end - self.start > 1
        crossed = np.cumsum(np.bincount(self.start[long] + 1, minlength=places) - np.bincount(end[long], minlength=places))
        cut = crossed[:places] == 0
        last_cut = np.maximum.accumulate(np.where(cut, np.arange(places), 0))
        before = np.concatenate([[0], last_cut[:-1]])
        depth = end - before[end]  # steps since the last cut before the end
        total = np.zeros(places)
        way = np.zeros(len(end))
        by_depth = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            edges = by_depth[a:b]
            to = end[edges]
            got = total[self.start[edges]] + log[edges]
            way[edges] = got
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(got, heads)
            runs = np.diff(np.append(heads, len(got)))
            value = top + np.log(np.add.reduceat(np.exp(got - np.repeat(top, runs)), heads))
            # a cut begins anew: only differences behind it count
            total[to[heads]] = np.where(cut[to[heads]], 0.0, value)
            way[edges] = got - np.repeat(value, runs)
        # summed within each place, so that a share never depends on what else is in the group
        share = np.exp(way)
        heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        runs = np.diff(np.append(heads, len(end)))
        for k in range(1, int(runs.max()) if len(runs) else 0):
            at = heads[runs > k] + k
            share[at] += share[at - 1]
        if len(heads):
            share[np.append(heads[1:], len(end)) - 1] = 2.0  # the last edge takes what rounding leaves
        return share


@cache
def _loaded(model: bytes, theta: float) -> Pieces:
    return Pieces(model, theta)


def load(model_file: str, theta: float = THETA) -> Pieces:
    return _loaded(Path(model_file).read_bytes(), theta)


def _sent(df: DataFrame, model_file: str):
    """The model file's bytes, read on the driver: a few megabytes at most, and executors need no file of their own."""
    return df.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())


CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def chunks(text: str) -> list[str]:
    return list(chunk_stream(text))


def chunk_stream(text: str) -> Iterator[str]:
    """The chunks of a text one after another. A literal mark is no space: it is a chunk of its own, that only byte pieces cover."""
    if not text:
        return
    for k, part in enumerate(text.split(MARK) if MARK in text else (text,)):
        if k:
            yield LITERAL
        yield from map(itemgetter(0), CHUNK.finditer((MARK if not k else "") + part.replace(" ", MARK)))


def draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1): a hash of the row's seed and the place."""
    with np.errstate(over="ignore"):
        x = seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Sampler:
    """Segments groups of texts."""

    def __init__(self, pieces: Pieces, seed: int = SEED):
        self.pieces, self.seed = pieces, seed

    def encode(self, keys: list, texts: list[str]) -> list[np.ndarray]:
        """The sampled ids of each text. A group holds about ``GROUP`` characters: many texts, or a part of a long one."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts: list[tuple] = []  # key, chunks, characters of the text before them, text
        held = 0

        def close() -> None:
            for (*_, i), ids in zip(parts, self._group(parts), strict=True):
                out[i].append(ids)
            parts.clear()

        for i, (key, text) in enumerate(zip(keys, texts, strict=True)):
            own, before, n = [], 0, 0
            for chunk in chunk_stream(text):
                own.append(chunk)
                n += 1 if chunk == LITERAL else len(chunk)
                if held + n >= GROUP:
                    parts.append((key, own, before, i))
                    close()
                    own, before, n, held = [], before + n, 0, 0
            if own or not before:
                parts.append((key, own, before, i))
                held += n
        if parts:
            close()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _group(self, parts: list[tuple]) -> list[np.ndarray]:
        found = [chunk for _, own, _, _ in parts for chunk in own]
        owner_n = [len(own) for _, own, _, _ in parts]
        known: dict[str, int] = defaultdict(count().__next__)
        number = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
        lattice = Lattice(self.pieces, list(known))
        base, size = lattice.base[number], lattice.size[number]
        owner = np.repeat(np.arange(len(parts)), owner_n)
        before = np.cumsum(size) - size
        first = np.concatenate([[0], np.cumsum(owner_n)[:-1]]).astype(np.int64)
        at_text = before - np.repeat(before[np.minimum(first, len(before) - 1)], owner_n) if len(before) else before
        at_text = at_text + np.array([before for _, _, before, _ in parts], np.int64)[owner]
        seeds = np.array([xxhash.xxh64_intdigest("" if k is None else str(k), self.seed) for k, *_ in parts], np.uint64)[owner]
        node, live = base + size, np.arange(len(number))
        steps = []
        while len(live):
            here = node[live]
            u = draws(seeds[live], at_text[live] + here - base[live])
            edge = lattice.first[here]
            more = np.flatnonzero(lattice.share[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[lattice.share[edge[more]] <= u[more]]
            steps.append((live, lattice.number[edge]))
            node[live] = lattice.start[edge]
            live = live[node[live] > base[live]]
        length = np.zeros(len(number), np.int64)
        for live, _ in steps:
            length[live] += 1
        end = np.cumsum(length)
        ids = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
        for k, (live, got) in enumerate(steps):
            ids[end[live] - 1 - k] = got
        cuts = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(owner_n)]).astype(np.int64)]
        return [self._bytes(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Byte pieces for characters without a piece; a literal mark counts as such."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        out, last = [], 0
        for i in odd:
            out += [ids[last:i], np.array([self.pieces.byte_number[b] for b in chr(-int(ids[i]) - 1).encode()], np.int32)]
            last = i + 1
        return np.concatenate([*out, ids[last:]])

    def decode(self, ids) -> str:
        parts = (ids[a : a + 1_000_000] for a in range(0, len(ids), 1_000_000))
        return b"".join(b"".join(map(self.pieces.bytes.__getitem__, x.tolist() if isinstance(x, np.ndarray) else x)) for x in parts).decode()[1:]


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, theta: float = THETA) -> DataFrame:
    """id, ids, n_pieces, lossless (the ids decode to the text)."""
    kind, sent = docs.schema[id_col].dataType.simpleString(), _sent(docs, model_file)

    def work():
        sampler = Sampler(_loaded(sent.value, theta), seed)

        def do(batch):
            keys, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            ids = sampler.encode(keys, [t or "" for t in texts])
            same = [None if t is None else sampler.decode(x) == t for x, t in zip(ids, texts, strict=True)]
            none = pa.array([t is None for t in texts], pa.bool_())
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids or [np.zeros(0, np.int32)]), pa.int32()), mask=none)
            return {"id": batch.column("id"), "ids": flat, "n_pieces": [None if t is None else len(x) for x, t in zip(ids, texts, strict=True)], "lossless": same}

        return do

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, ids array<int>, n_pieces long, lossless boolean", work, rows=2000).withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text", theta: float = THETA) -> DataFrame:
    """``encoded`` with the text that the ids stand for."""
    schema, sent = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), _sent(encoded, model_file)

    def work():
        sampler = Sampler(_loaded(sent.value, theta))

        def do(batch):
            texts = [None if x is None else sampler.decode(x) for x in batch.column(ids_col).to_pylist()]
            return {c: batch.column(c) for c in batch.schema.names} | {text_col: texts}

        return do

    return map_batches(encoded, f"{schema}, `{text_col}` string", work)
