import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import golay, linededup, overlap, simhash

SPACED = re.compile("[^\x20\x09-\x0d]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_of(text):
    words = SPACED.findall((text or "").translate(ASCII))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, ids):
    """Smallest id reachable through links of at most four bits."""
    values = sorted(set(prints))
    seen = {}
    for start in values:
        if start in seen:
            continue
        seen[start], ahead = start, [start]
        while ahead:
            x = ahead.pop()
            for y in values:
                if y not in seen and (x ^ y).bit_count() <= 4:
                    seen[y] = start
                    ahead.append(y)
    least = {}
    for p, i in zip(prints, ids, strict=True):
        least[seen[p]] = min(i, least.get(seen[p], i))
    return {i: least[seen[p]] for p, i in zip(prints, ids, strict=True)}


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
@settings(max_examples=300, deadline=None)
def test_linked_prints_share_a_key(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    keys, owner = simhash.index_keys(np.array([x, y], np.uint64))
    assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@given(st.integers(0, 2**23 - 1), st.lists(st.integers(0, 22), max_size=3))
@settings(max_examples=200, deadline=None)
def test_three_errors_are_corrected(word, flips):
    index = golay.decode(np.array([word], np.uint32))[0]
    code = word ^ int(golay._corrections()[golay.syndrome(np.array([word], np.uint32))][0])
    assert code >> 11 == index and (code ^ word).bit_count() <= 3
    for b in set(flips):
        code ^= 1 << b
    assert golay.decode(np.array([code], np.uint32))[0] == index


def near_copies(n, rng):
    """Long texts and copies with a few words changed."""
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(150, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    return texts


def test_against_all_pairs(frame, odd):
    texts = odd + near_copies(60, random.Random(5)) + ["a b c", "a b c", "A B  C"]
    prints = [print_of(t) for t in texts]
    want = groups(prints, range(len(texts)))
    got = simhash.near_duplicates(frame(texts).repartition(3)).collect()
    assert {r.id: r.fp % 2**64 for r in got} == dict(enumerate(prints))
    assert {r.id: r.component for r in got} == want
    kept = simhash.keep_one(frame(texts))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == frame(texts).columns


@pytest.mark.parametrize("block", [16, 37])
def test_long_runs_go_through_blocks(spark, monkeypatch, block):
    """A few bits flip around one print, so that most keys are shared by all."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 6, 7) for _ in range(60)} | {int(x) for x in rng.integers(0, 2**63, 50)})
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(nodes, 3)).collect()}
    want = groups(prints, prints)
    by_root = {}
    for p in prints:
        by_root.setdefault(roots.get(p, p), set()).add(p)
    wanted = {}
    for p in prints:
        wanted.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, wanted.values()))


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == got[1000] == 1000


def test_null_ids_and_empty(frame):
    docs = frame(["same words in here", "same words in here", None, "", "other"], [None, 4, 9, 2, None])
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.id is None, r.component or 0) for r in got) == [(False, 2), (False, 2), (False, 4), (True, 0), (True, 4)]
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {2, 4, None}
    assert simhash.near_duplicates(frame([]).where("false")).count() == 0


ONE_ID = (["first text of the id here", "quite another one under the id", "first text of the id here", "some other text", "some other text", None], [5, 5, 5, 7, 5, None])


def test_texts_under_one_id_stay(frame):
    docs = frame(*ONE_ID).selectExpr("*", "1 as fp", "2 as print", "'x' as _odd_id")
    for kept in (simhash.keep_one(docs), overlap.keep_one(docs)):
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (5, ONE_ID[0][0]), (5, ONE_ID[0][1]), (5, "some other text")]


def test_very_long_text(frame):
    long = " ".join(str(i % 7001) for i in range(200_000))
    kept = simhash.keep_one(frame([long, f"{long} end", "other"]))
    assert {r.doc_id for r in kept.collect()} == {0, 2}


def lines_without(texts, ids):
    """Windows of three worded lines over all texts in order of id; later ones are covered."""
    split, worded = [(t or "").split("\n") for t in texts], []
    for lines in split:
        worded.append([p for p, x in enumerate(lines) if SPACED.search(x)])
    windows = []
    for d in sorted(range(len(texts)), key=lambda d: ids[d]):
        at, lines = worded[d], split[d]
        size = min(3, len(at))
        found = {(at[i], at[i + size - 1], (size, *(lines[p] for p in at[i : i + size]))) for i in range(len(at) - size + 1)} if size else set()
        windows += [(d, *w) for w in sorted(found)]
    seen, gone = set(), [set() for _ in texts]
    for d, p, q, content in sorted(windows, key=lambda w: (ids[w[0]], w[1])):
        if content in seen:
            gone[d] |= set(range(p, q + 1))
        seen.add(content)
    return [None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in g) for t, lines, g in zip(texts, split, gone, strict=True)], [len(g) for g in gone]


def test_line_dedup_against_scanning(frame, odd):
    rng = random.Random(4)
    pool = [f"line {i} of the pool" for i in range(12)] + ["", "  ", " ".join(["long"] * 60)]
    texts = [t if t is None else t for t in odd if t is None or len(t) < 4000] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    texts = list(dict.fromkeys(texts))
    want, removed = lines_without(texts, range(len(texts)))
    docs = frame(texts).selectExpr("*", "1 as a", "2 as b", "'z' as covered")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs, removed_col="n_removed").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(want):
        assert (got[i].text, got[i].n_removed) == (t, removed[i]) and (got[i].a, got[i].b, got[i].covered) == (1, 2, "z")


def test_line_dedup_defined_cases(frame):
    passage = "first line\nsecond line\nthird line"
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame([passage, f"before\n{passage}\nafter", None, "", f"{passage}\n{passage}"])).collect()}
    assert got == {0: passage, 1: "before\nafter", 2: None, 3: "", 4: ""}
    long = " ".join(["long"] * 60)
    short = {r.doc_id: r.text for r in linededup.dedup_lines(frame([f"{long}\nb", f"{long}\nb", f"{long}\nc", long, f"{long}\nb\nc\nd"])).collect()}
    assert short == {0: f"{long}\nb", 1: "", 2: f"{long}\nc", 3: long, 4: f"{long}\nb\nc\nd"}
    assert linededup.dedup_lines(frame([]).where("false")).count() == 0
    again = linededup.dedup_lines(frame(["x\ny\nz", "x\ny\nz"], [None, None])).collect()
    assert [r.text for r in again] == ["x\ny\nz"] * 2
