"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, share their backoff. At the top stand a class's pairs, counted by
documents; below them its words, by Kneser-Ney continuation counts (distinct words before); below both the continuation
counts of all classes together. Each class count is discounted by ``FLAT`` and by ``SHARE`` times what the shared backoff
expects of it, and the mass goes to the backoff: a rare expression, or one that is about as common in both classes,
weighs alike in both, so that language and subject don't move the ratio. That is more than Kneser and Ney take: with one
discount a level, estimated from counts of counts, subjects drown the few words that tell (README has the figures).
Copies of a text teach once.
A text's evidence is the log-likelihood ratio of its words, by their number (and ``PRIOR_WORDS`` more, so that a short
text needs strong words). A logistic curve, fitted on labelled rows that the counts leave out, turns it into a score.

The models learn from at most ``SAMPLE`` labelled rows, those with the smallest hash of the id; words in fewer than
``MIN_DOCS`` and pairs in fewer than ``MIN_PAIRS`` documents are left to the backoff. All are parameters. The models are
so bounded in size, and go to every task.

Defined results: a text without words has no evidence and gets the score of that; an empty table gives no rows; texts of any
length are read whole; ids that tie in hash are ordered by id, and rows of one id all belong to the sample or none; columns
other than those named are not read by ``score_texts`` and pass through ``drop_toxic``; rows without a label, or with a null
one, teach nothing; of several labels of one id the largest counts; without rows of both classes every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, letter_words, map_batches, remainder, written

SAMPLE, MIN_DOCS, MIN_PAIRS, PRIOR_WORDS = 12_000, 4, 6, 8
FLAT, FLAT_PAIRS, SHARE = 2.0, 8.0, 2.0
UNKNOWN, START = 0, 1


@dataclass(frozen=True)
class Model:
    vocabulary: dict[bytes, int]
    word: np.ndarray  # log2 ratio of the class unigrams
    backoff: np.ndarray  # log2 ratio of the backoff weights, by context
    pairs: np.ndarray  # sorted context * size + word
    pair: np.ndarray  # log2 ratio of those pairs
    middle: float = 0.0
    slope: float = 0.0

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        get = self.vocabulary.get
        numbers, lengths = [], []
        for text in texts:
            words = letter_words(text)
            lengths.append(len(words))
            numbers.append(START)
            numbers += [get(w, UNKNOWN) for w in words]
        ids = np.array(numbers, np.int64)
        lengths = np.array(lengths)
        first = np.cumsum(lengths + 1) - lengths - 1
        value = np.zeros(len(ids))
        here, before = ids[1:], ids[:-1]
        gain = self.backoff[before] + self.word[here]
        if len(self.pairs):
            key = before * len(self.word) + here
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            gain = np.where(self.pairs[at] == key, self.pair[at], gain)
        value[1:] = gain
        value[first] = 0.0  # a start stands in no text
        return np.add.reduceat(value, first) / (lengths + PRIOR_WORDS) if len(first) else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.slope:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.evidence(texts) - self.middle), -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic, fit) of at most ``sample`` labelled documents; a quarter is for fitting the curve."""
    said = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), "id")
    chosen = said.withColumn("order", order).orderBy("order", "id").limit(sample).select("id", "toxic", (F.pmod("order", F.lit(4)) == 0).alias("fit"))
    # at most ``sample`` slim rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return written(rows.select("text", "toxic", "fit").dropDuplicates(["text", "toxic"]))


def count_words(rows: DataFrame) -> DataFrame:
    """word, documents of both classes: only words in enough of them."""
    def work():
        def do(batch):
            found: dict[bytes, int] = {}
            for text in batch.column("text").to_pylist():
                for w in set(letter_words(text)):
                    found[w] = found.get(w, 0) + 1
            return {"word": list(found), "docs": list(found.values())}

        return do

    return map_batches(rows, "word binary, docs long", work).groupBy("word").agg(F.sum("docs").alias("docs"))


def count_pairs(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """before (hash of any word), context (its number, or UNKNOWN), word: documents of each class where word follows."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        get = sent.value.get

        def do(batch):
            found: dict[tuple, list[int]] = {}
            for text, t in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = letter_words(text)
                for pair in set(zip([b"", *words[:-1]], words, strict=True)):
                    found.setdefault(pair, [0, 0])[t > 0] += 1
            return {
                "before": np.fromiter((xxhash.xxh64_intdigest(h) for h, _ in found), np.uint64, len(found)).view(np.int64),
                "context": [get(h, UNKNOWN) if h else START for h, _ in found],
                "word": [get(w, UNKNOWN) for _, w in found],
                "ordinary": [n for n, _ in found.values()],
                "toxic": [n for _, n in found.values()],
            }

        return do

    counted = map_batches(rows.select("text", "toxic"), "before long, context long, word long, ordinary long, toxic long", work)
    return counted.groupBy("before", "context", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def kneser_ney(vocabulary: dict[bytes, int], pairs: DataFrame, min_pairs: int) -> Model:
    """Sums by word and context come from Spark; what is collected is bounded by the vocabulary and by the kept pairs."""
    size = len(vocabulary) + 2
    classes = ("ordinary", "toxic")
    both = F.col("ordinary") + F.col("toxic")
    by_word = pairs.groupBy("word").agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in classes)).toPandas()
    by_context = pairs.groupBy("context").agg(*(F.sum(c).alias(c) for c in classes)).toPandas()
    kept = pairs.where((F.col("context") != UNKNOWN) & (F.col("word") != UNKNOWN) & (both >= min_pairs)).toPandas()
    context, word = kept["context"].to_numpy(np.int64), kept["word"].to_numpy(np.int64)
    continuation, contexts = ({c: np.zeros(size) for c in classes} for _ in range(2))
    for c in classes:
        continuation[c][by_word["word"]] = by_word[c]
        contexts[c][by_context["context"]] = by_context[c]
    shared = continuation["ordinary"] + continuation["toxic"] + 0.5
    shared /= shared.sum()
    together = (kept["ordinary"] + kept["toxic"]).to_numpy() / np.maximum(1, (contexts["ordinary"] + contexts["toxic"])[context])
    unigram, backoff, explicit = {}, {}, {}
    for c in classes:
        total = max(1.0, continuation[c].sum())
        held = np.maximum(continuation[c] - FLAT - SHARE * total * shared, 0) / total
        unigram[c] = held + (1 - held.sum()) * shared
        n = contexts[c][context]
        own = np.maximum(kept[c].to_numpy() - FLAT_PAIRS - SHARE * n * together, 0) / np.maximum(n, 1)
        backoff[c] = 1 - np.bincount(context, own, size)
        # below a pair of the class: what all classes say of the pair, moved as the class moves the word
        explicit[c] = own + backoff[c][context] * together * unigram[c][word] / shared[word]
    key = context * size + word
    order = np.argsort(key)
    ratio = lambda x: np.log2(x["toxic"]) - np.log2(x["ordinary"])
    return Model(vocabulary, ratio(unigram), ratio(backoff), key[order], ratio(explicit)[order])


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Middle and slope of the score: the middle errs least over the rows, the slope is then the likeliest."""
    order = np.argsort(evidence, kind="stable")
    e, t = evidence[order], toxic[order].astype(float)
    hits = np.cumsum(t[::-1])[::-1]  # toxic rows from each place on
    size = np.arange(len(t), 0, -1)
    f1 = 2 * hits / (size + t.sum())
    best = int(np.argmax(f1))
    middle = float((e[best] + e[best - 1]) / 2) if best else float(e[0]) - 1e-9
    x, slope = e - middle, 1.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -50, 50)))
        step = float((x * (t - p)).sum() - 1e-3 * slope) / (float((x * x * p * (1 - p)).sum()) + 1e-3)
        slope = max(0.1, slope + float(np.clip(step, -5, 5)))
        if abs(step) < 1e-6:
            break
    return middle, slope


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, min_docs: int = MIN_DOCS, min_pairs: int = MIN_PAIRS) -> Model:
    rows = training_rows(docs, labels, F.lit(True) if allowed is None else allowed, id_col, text_col, label_col, sample)
    counted, held = rows.where("not fit"), rows.where("fit")
    words = sorted(bytes(r["word"]) for r in count_words(counted).where(F.col("docs") >= min_docs).select("word").collect())
    vocabulary = {w: i + 2 for i, w in enumerate(words)}
    none = Model({}, np.zeros(2), np.zeros(2), np.zeros(0, np.int64), np.zeros(0))
    classes = {r["toxic"] > 0 for r in rows.select("toxic").distinct().collect()}
    if classes != {True, False}:
        return none
    model = kneser_ney(vocabulary, written(count_pairs(counted, vocabulary)), min_pairs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def do(batch):
            return {"evidence": sent.value.evidence(batch.column("text").to_pylist()), "toxic": batch.column("toxic")}

        return do

    shown = map_batches(held.select("text", "toxic"), "evidence double, toxic int", work).toPandas()
    if not (shown["toxic"] > 0).any() or (shown["toxic"] > 0).all():
        return none
    middle, slope = fit_curve(shown["evidence"].to_numpy(), shown["toxic"].to_numpy() > 0)
    return Model(model.vocabulary, model.word, model.backoff, model.pairs, model.pair, middle, slope)


def score_texts(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` and the score, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh(docs, "_toxic_text")
    source = docs.select(*keep, F.col(text_col).alias(text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def work():
        model = sent.value

        def do(batch):
            return {c: batch.column(c) for c in keep} | {score_col: model.score(batch.column(text).to_pylist())}

        return do

    return map_batches(source, f"{kept}, `{score_col}` double", work)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score is below ``least``, with all their columns."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches):
        for batch in batches:
            parts = [batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)]
            for part in parts:
                yield part.filter(pa.array(sent.value.score(part.column(text_col).to_pylist()) < least))

    return docs.mapInArrow(clean, docs.schema)


def held_out(id_col: Column, folds: int = 5) -> Column:
    return remainder(id_col, folds) == 0
