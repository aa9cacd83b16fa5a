import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import pieces, toxicity
from weftline.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))


def test_held_out_accuracy(spark, model):
    d = "/root/testdata/sf0.1"
    rows = toxicity.score_texts(spark.read.parquet(f"{d}/documents.parquet"), model, ["doc_id"]).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    toxic, clean = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) / len(rows)
    assert auc > 0.9 and right > 0.9
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_odd_texts(frame, model, odd):
    got = toxicity.score_texts(frame(odd), model, ["doc_id"]).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[0] == score[1] == score[2] < 0.5
    kept = toxicity.drop_toxic(frame(odd).withColumn("score", F.lit("x")).withColumn("Toxic", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "Toxic"]
    assert toxicity.score_texts(frame(odd).where("false"), model, ["doc_id"]).count() == 0


def test_no_labels_score_nothing(spark, frame):
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    none = toxicity.train(frame(["a b", "c d"]), labels)
    assert [r.score for r in toxicity.score_texts(frame(["a b", None]), none, ["doc_id"]).collect()] == [0.0, 0.0]


def class_models(texts, min_pairs):
    """By counting: of either class the unigrams, what is left to the backoff, and the kept pairs, word by word."""
    pairs = {c: Counter(p for t, toxic in texts if toxic == c for p in set(zip(["", *t.split()[:-1]], t.split(), strict=True))) for c in (0, 1)}
    words = sorted({w for c in pairs for _, w in pairs[c]})
    heard = {c: Counter(w for _, w in pairs[c]) for c in pairs}
    context = {c: Counter() for c in pairs}
    for c in pairs:
        for (h, _), n in pairs[c].items():
            context[c][h] += n
    both = {w: heard[0][w] + heard[1][w] + 0.5 for w in words}
    rest = sum(both.values()) + 2 * 0.5  # the unknown word and the start
    shared = {w: n / rest for w, n in both.items()} | {None: 0.5 / rest}
    kept = {p for p in set(pairs[0]) | set(pairs[1]) if pairs[0][p] + pairs[1][p] >= min_pairs}
    unigram, left, pair = {}, {}, {}
    for c in pairs:
        total = sum(heard[c].values())
        held = {w: max(0.0, heard[c][w] - toxicity.FLAT - toxicity.SHARE * total * shared[w]) / total for w in words}
        unigram[c] = {w: held.get(w, 0.0) + (1 - sum(held.values())) * shared[w] for w in shared}
        own = {}
        for h, w in kept:
            together = (pairs[0][h, w] + pairs[1][h, w]) / max(1, context[0][h] + context[1][h])
            own[h, w] = max(0.0, pairs[c][h, w] - toxicity.FLAT_PAIRS - toxicity.SHARE * context[c][h] * together) / max(1, context[c][h])
        left[c] = {h: 1 - sum(x for (a, _), x in own.items() if a == h) for h in [*words, ""]}
        pair[c] = {(h, w): own[h, w] + left[c][h] * (pairs[0][h, w] + pairs[1][h, w]) / max(1, context[0][h] + context[1][h]) * unigram[c][w] / shared[w] for h, w in kept}
    return unigram, left, pair


def test_class_models_against_counting(spark):
    """The unigrams of either class and its unknown words sum to one; evidence is that of the models, word by word."""
    rng = np.random.default_rng(0)
    letters = [f"w{i}" for i in range(200)]
    spoken = [*letters, "m", "n", "o"]
    texts = [(" ".join([*rng.choice(letters, 12), *(["m", "n", "o"] if i % 10 == 0 and i % 50 else [])]), int(i % 10 == 0)) for i in range(600)]
    rows = spark.createDataFrame([(t, c, False) for t, c in texts], "text string, toxic int, fit boolean")
    vocabulary = {w.encode(): i + 2 for i, w in enumerate(spoken)}
    built = toxicity.kneser_ney(vocabulary, toxicity.count_pairs(rows, vocabulary), 6)
    unigram, left, pair = class_models(texts, 6)
    for c in (0, 1):
        assert sum(unigram[c].values()) + unigram[c][None] == pytest.approx(1)
    new = [" ".join(rng.choice([*letters, "zz"], rng.integers(0, 20))) for _ in range(50)] + ["m n o", "", None, "zz zz"]
    for text, got in zip(new, built.evidence(new), strict=True):
        words, total = (text or "").split(), 0.0
        for h, w in zip(["", *words], words, strict=False):
            at = [pair[c].get((h, w)) or left[c].get(h, 1.0) * unigram[c].get(w, unigram[c][None]) for c in (0, 1)]
            total += math.log2(at[1]) - math.log2(at[0])
        assert got == pytest.approx(total / (len(words) + toxicity.PRIOR_WORDS), abs=1e-9)
    assert built.evidence(["m n o"])[0] > 0.1 > abs(built.evidence(["w1 w2 w3 w4"])[0])


def test_empty_very_long_and_tied(spark, frame, model):
    assert toxicity.score_texts(frame([]).where("false"), model, ["doc_id"]).count() == 0
    none = toxicity.train(frame([]).where("false"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score(["anything"]).tolist() == [0.0]
    long = toxicity.score_texts(frame(["word " * 400_000, "word " * 10]), model, ["doc_id"]).collect()
    assert all(0 <= r.score < 0.5 for r in long)
    rows = [toxicity.training_rows(frame(["a", "b", "c", "d"], [1, 2, 3, 3]).repartition(n), spark.createDataFrame([(i, 1) for i in (1, 2, 3, 3)], "doc_id long, toxic int"), F.lit(True), "doc_id", "text", "toxic", 2) for n in (1, 3)]
    assert sorted(r.text for r in rows[0].collect()) == sorted(r.text for r in rows[1].collect())


def test_round_trip(spark, frame, odd, sf_dir):
    texts = odd + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["▁", "▁▁ ▁", " lead", "trail ", "a  b", "▁x \n▁y"]
    done = pieces.encode_texts(frame(texts), PIECE_MODEL).collect()
    for r in done:
        assert r.lossless == (None if texts[r.doc_id] is None else True)
    back = pieces.decode_texts(pieces.encode_texts(frame(texts), PIECE_MODEL), PIECE_MODEL).collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    again = {r.doc_id: r.ids for r in pieces.encode_texts(frame(texts).repartition(7), PIECE_MODEL).collect()}
    assert all(again[r.doc_id] == r.ids for r in done)
    assert pieces.encode_texts(frame(texts).where("false"), PIECE_MODEL).count() == 0


def test_samples_follow_the_lattice():
    """Frequencies of sampled segmentations against the probabilities of all of them."""
    model = pieces.load(PIECE_MODEL)
    sampler = pieces.Sampler(model)
    text, n = "tree", 20_000
    chunk = pieces.chunks(text)[0]
    weights = {}
    for cuts in itertools.product([0, 1], repeat=len(chunk) - 1):
        parts, last = [], 0
        for i, c in enumerate((*cuts, 1)):
            if c:
                parts.append(chunk[last : i + 1])
                last = i + 1
        if all(p in model.number for p in parts):
            weights[tuple(model.number[p] for p in parts)] = math.prod(model.weight[p] for p in parts)
    total = sum(weights.values())
    seen = Counter(tuple(x.tolist()) for x in sampler.encode(list(range(n)), [text] * n))
    assert set(seen) <= set(weights)
    for path, w in weights.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_a_key_gives_one_segmentation():
    sampler = pieces.Sampler(pieces.load(PIECE_MODEL))
    a = sampler.encode([1, 2, None], ["reproducible sampling"] * 3)
    b = pieces.Sampler(pieces.load(PIECE_MODEL)).encode([None, 1], ["reproducible sampling"] * 2)
    assert a[0].tolist() == b[1].tolist() and a[2].tolist() == b[0].tolist()


@given(st.lists(st.text(st.sampled_from("abet ▁é日x\n"), max_size=40), min_size=1, max_size=12), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_shares_do_not_depend_on_the_group(texts, rng):
    """Bit for bit: each chunk's shares alone and among others, in another order."""
    model = pieces.load(PIECE_MODEL)
    found = sorted({c for t in texts if "▁" not in t for c in pieces.chunks(t)} | {"▁the", "▁segmentation", "▁" + "ab" * 50})

    def shares(chunks):
        lattice = pieces.Lattice(model, chunks)
        return {c: [lattice.share[lattice.first[b + k] : lattice.first[b + k + 1]].tobytes() for k in range(1, n + 1)] for c, b, n in zip(chunks, lattice.base.tolist(), lattice.size.tolist(), strict=True)}

    whole = shares(found)
    other = list(found)
    rng.shuffle(other)
    half = len(other) // 2
    assert whole == shares(other) | {} and whole == shares(other[:half]) | shares(other[half:])
