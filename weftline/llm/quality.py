"""Quality rules: counts of words, symbols, repeated lines and repeated word windows, and compression bands.

The bands hold zstandard ratios (bytes by compressed bytes) of the whole text and of its fixed chunks: text of ordinary
language lies in a narrow band that moves with length. A ratio above the band's end means repetition, one below its start
means noise. Chunks catch what a long ordinary rest would hide; a last chunk of under half the size joins the one before.

Defined results: null and empty texts have no words and fail the base rules; repeated rows, ties and all, each get their row;
texts of any length are counted whole; an empty table gives no rows; other columns are not read, so their names cannot clash; an id
column with the name of a result column raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import check_id, map_batches

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """whole: (bytes from which the band holds, lowest ratio, highest ratio), rising; chunk: lowest and highest ratio."""

    whole: tuple = ((0, 0.0, 4.0), (128, 0.8, 3.0), (256, 1.05, 3.5), (512, 1.2, 4.0), (1024, 1.35, 4.5), (4096, 1.5, 6.0), (65536, 1.6, 9.0))
    chunk_bytes: int = 4096
    chunk: tuple = (1.4, 6.0)
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, pair = np.unique(word[:-1] * len(ids) + word[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(ids) + word[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.encode().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def ratios(raw: bytes, bands: Bands, packer) -> tuple[float, float, float]:
    """Of the whole, and the lowest and highest of the chunks."""
    whole = len(raw) / len(packer.compress(raw)) if raw else 0.0
    size = bands.chunk_bytes
    if len(raw) < 1.5 * size:
        return whole, whole, whole
    cuts = list(range(0, len(raw), size))
    if len(raw) - cuts[-1] < size / 2:
        cuts.pop()
    parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
    each = [len(p) / len(packer.compress(p)) for p in parts]
    return whole, min(each), max(each)


def in_band(n_bytes: int, whole: float, low: float, high: float, bands: Bands) -> bool:
    _, least, most = max(b for b in bands.whole if n_bytes >= b[0])
    if not least <= whole <= most:
        return False
    return n_bytes < 1.5 * bands.chunk_bytes or (low >= bands.chunk[0] and high <= bands.chunk[1])


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, chunk_low, chunk_high, base_failed, kept."""
    check_id(id_col, "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, chunk_low, chunk_high, base_failed, kept")
    kind = docs.schema[id_col].dataType.simpleString()

    def work():
        packer = zstandard.ZstdCompressor(level=bands.level)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "chunk_low", "chunk_high", "base_failed", "kept")

        def do(batch):
            out = {k: [] for k in names}
            for text in batch.column("text").to_pylist():
                text = text or ""
                raw = text.encode()
                words = raw.split()
                chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c")))
                repeat = repeated_words(words)
                failed = len(words) < 50 or 100 * repeat > 50 * len(words)
                found = ratios(raw, bands, packer)
                row = (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(text), repeat, *found, failed, not failed and in_band(len(raw), *found, bands))
                for values, x in zip(out.values(), row, strict=True):
                    values.append(x)
            return out | {"id": batch.column("id")}

        return do

    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunk_low double, chunk_high double, base_failed boolean, kept boolean"
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, work).withColumnRenamed("id", id_col)
