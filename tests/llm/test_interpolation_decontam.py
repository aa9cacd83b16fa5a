import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import decontam, interpolation

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def brute(texts, ids, model):
    tokens = [SPACED.findall((t or "").translate(ASCII)) + [None] for t in texts]
    unigram, pair, context = Counter(), Counter(), Counter()
    for t, i in zip(tokens, ids, strict=True):
        if fold(i) != 2:
            unigram.update(t)
            pair.update(zip(["<s>", *t[:-1]], t, strict=True))
            context.update(["<s>", *t[:-1]])
    n, v = sum(unigram.values()), len(unigram)
    assert (model.train_tokens, model.distinct) == (n, v)
    out = {}
    for t, i in zip(tokens, ids, strict=True):
        base = sum(math.log10((unigram[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip(["<s>", *t[:-1]], t, strict=True):
            c = context[h]
            lam = model.weights[min(interpolation.CONTEXT_BUCKETS - 1, c.bit_length())]
            score += math.log10(lam[0] * pair[h, w] / max(c, 1) + lam[1] * unigram[w] / max(n, 1) + lam[2] / (v + 1))
        out[i] = (fold(i) == 2, len(t), sum(unigram[w] > 0 for w in t), n, base, score)
    return out


def test_scores_against_counting(spark, frame, odd, sf_dir):
    texts = odd + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = frame(texts).repartition(3)
    model, _ = interpolation.fit(interpolation.blocks(docs, "doc_id", "text"))
    want = brute(texts, range(len(texts)), model)
    got = interpolation.score(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        held, n, known, train, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-6)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_small_blocks_and_many_levels_change_nothing(frame, bits):
    """Blocks of a few texts, in groups of two, four and 256: up to six levels of sums."""
    texts = [f"the cat {i % 5} sat on the mat {i}" for i in range(120)] + [None, ""]
    rows = lambda df: sorted((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in df.collect())
    want = rows(interpolation.score(frame(texts).repartition(1)))
    assert rows(interpolation.score(frame(texts).repartition(5), block_tokens=20, bits=bits)) == want


def test_expectation_maximisation_rises():
    rng = np.random.default_rng(3)
    p, n = rng.random((50, 3)), rng.integers(1, 9, 50).astype(float)
    last, weights = -math.inf, np.full(3, 1 / 3)
    for _ in range(20):
        weights = interpolation.expectation_maximisation(p, n, weights, 1)
        now = float((n * np.log(p @ weights)).sum())
        assert now >= last - 1e-9
        last = now
    assert weights.sum() == pytest.approx(1)


def test_nothing_to_learn_from(frame):
    ids = [i for i in range(100) if fold(i) == 2][:3]
    got = interpolation.score(frame(["a b", None, "c"], ids)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert interpolation.score(frame([]).where("false")).count() == 0


def leaks(text, items, width=10):
    words = LETTERS.findall((text or "").translate(ASCII))
    hit, found = set(), set()
    for item, body in items:
        own = LETTERS.findall((body or "").translate(ASCII))
        for k in range(max(1, len(own) - width + 1) if own else 0):
            run = own[k : k + width]
            for i in range(len(words) - len(run) + 1):
                if words[i : i + len(run)] == run:
                    hit |= set(range(i, i + len(run)))
                    found |= set() if item is None else {str(item)}
    return len(words), hit, sorted(found)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (20, "Short item"), (3, None), (4, "…!"), (1, "a second text of the same id with enough words to make several windows"), (5, "x"), (None, "nameless but whole"), (None, "Short item")]


def test_decontamination_against_scanning(spark, frame, odd):
    texts = odd + ["ONE two, three four-five six seven eight nine ten eleven", "two three four five six seven eight nine ten eleven twelve", "a short item. SHORT ITEM short", "shortitem", "x x", "it is nameless, but whole!", "one two three four five six seven eight nine"]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard in (50_000, 3):
        got = {r.doc_id: r for r in decontam.find_leaks(frame(texts), items, ["doc_id"], shard_words=shard, spans=True).collect()}
        for i, text in enumerate(texts):
            n, hit, found = leaks(text, ITEMS)
            assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, len(hit), found)
            if hit:
                inside = [LETTERS.findall(text[s.start : s.end].translate(ASCII)) for s in got[i].spans]
                assert sum(map(len, inside)) == len(hit)
    kept = decontam.drop_leaks(frame(texts), items).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {i for i, t in enumerate(texts) if not leaks(t, ITEMS)[1]}
    assert decontam.find_leaks(frame(texts), items.where("false"), ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontam.find_leaks(frame([]).where("false"), items, ["doc_id"]).count() == 0


def test_clashing_columns(spark, frame):
    docs = frame(["short item"]).selectExpr("*", "1 as n_hit_", "'y' as _leak_text", "2 as items_")
    got = decontam.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), docs.columns[:1] + ["_leak_text"]).first()
    assert got._leak_text == "y" and got.n_hit == 2


def test_digest_of_no_items(spark, sf_dir):
    from weftline.llm.queries import op6_decontamination

    got = op6_decontamination(spark, sf_dir).where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest() and got.contaminated is False
