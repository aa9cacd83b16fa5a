import random
import re
from collections import Counter

import pytest
import zstandard

from weftline.llm import licenses, quality
from weftline.llm.license_rules import RULES

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_of(text):
    words = LETTERS.findall((text or "").translate(ASCII))
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def detections(text, rules):
    """Every rule without the keyword gate, and suppression by comparing each detection with all accepted before it."""
    low = (text or "").translate(ASCII)
    found = [(m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(low)]
    accepted = []
    for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].number)):
        if not any(a[0] <= d[0] and d[1] <= a[1] for a in accepted):
            accepted.append(d)
    return sorted(accepted, key=lambda d: (d[0], d[1], d[2].number))


TEXTS = [
    "Released under the MIT License. The mit  license! MIT\nlicense",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GNU General Public License version 3, or either version 2 of the License, or (at your option) any later version",
    "SPDX-License-Identifier: MIT and https://opensource.org/licenses/MIT; general public license general public license",
]


def test_base_counts_and_rules(spark, frame, odd, sf_dir):
    rules = licenses.parse_rules(RULES)
    assert len(rules) > 200
    texts = odd + TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text)
        if text is None or len(text) < 3000:
            want = detections(text, rules)
            assert [(d.start, d.end, d.rule) for d in r.detections] == [(a, b, x.number) for a, b, x in want]
            assert set(filter(None, r.labels.split(","))) == {x.label for *_, x in want} | set(filter(None, r.base_labels.split(",")))
        assert 0 <= r.score <= 1


def made_match(regex, rng):
    """A text that the rule's regex should match: choices, options and gaps by chance."""
    out = []
    for part, times in licenses.PART.findall(regex):
        if times and times[0] in "?*" and rng.random() < 0.5 or part[:3] in ("(?!", "(?=") or part in (r"\b", "^", "$"):
            continue
        if part[0] == "(":
            out.append(made_match(rng.choice(re.split(r"\|(?![^(]*\))", re.sub(r"^\(\?:|\)$|^\(", "", part))), rng))
        elif part[0] == "[":
            out.append(rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if re.fullmatch(part, c)]))
        elif part == " ":
            out.append(rng.choice([" ", "\n", "  # ", ", ", "\n        * "]))
        else:
            out.append({r"\d": "3", ".": "x"}.get(part, part[-1]))
    return "".join(out)


def test_every_match_passes_its_gate():
    rules, lines, rng = licenses.parse_rules(RULES), list(filter(None, map(str.strip, RULES.splitlines()))), random.Random(3)
    gate = licenses.keyword_gate(rules)
    matched = set()
    for rule, line in zip(rules, lines, strict=True):
        for _ in range(60):
            text = made_match(line.split(" | ", 2)[2], rng)
            if rule.pattern.search(text):
                matched.add(rule.number)
                assert rule.literals and all(x in text for x in rule.literals), (rule, text)
                assert any(rule in own for _, own in gate.iter(text)), (rule, text)
    assert len(matched) == len(rules), [lines[i] for i in set(range(len(rules))) - matched]


def test_wrapped_and_commented_notices(frame):
    texts = ["Permission is hereby granted,\n          # free of charge, to any person obtaining\n//         a copy", "redistribute it and/or modify it under the terms of the GNU General Public License", "Creative Commons Legal Code\n\nCC0 1.0 Universal", "developed by the product includes software developed by the OpenSSL Project", "PostgreSQL Licence", "the open rail-m license"]
    got = [r.labels for r in licenses.scan_licenses(frame(texts)).orderBy("doc_id").collect()]
    assert [x.split(",") for x in got] == [["mit"], ["gpl"], ["cc0-1.0"], ["openssl"], ["postgresql"], ["openrail"]]


def test_empty_table_and_null_id(frame):
    assert licenses.scan_licenses(frame([]).where("false")).count() == 0
    assert licenses.scan_licenses(frame(["mit license"], [None])).first().n_base == 1
    long = licenses.scan_licenses(frame([f"{'word ' * 300_000}mit license"]).selectExpr("*", "1 as labels", "2 as n_words")).first()
    assert (long.n_words, long.first_word, long.labels) == (300_002, 300_000, "mit")


def quality_of(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def test_quality_counts(spark, frame, odd, sf_dir):
    texts = odd + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in quality.score_quality(frame(texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_of(text)
        assert not (r.kept and r.base_failed)
    assert quality.score_quality(frame([]).where("false")).count() == 0


def test_bands_reject_repetition_and_noise(spark, frame, sf_dir):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randrange(33, 0x2FF)) for _ in range(8)) for _ in range(2000))
    loop = " ".join(f"word{i % 40}" for i in range(4000))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in quality.score_quality(frame([noise, loop])).collect()}
    assert not got[0].kept and not got[1].kept and got[0].ratio < 1.4 < got[1].ratio
    sound = quality.score_quality(docs).where("not base_failed").collect()
    assert sum(r.kept for r in sound) > 0.8 * len(sound)


@pytest.mark.parametrize("size", [0, 1, 4096, 6143, 6144, 10_000, 70_000])
def test_chunks_cover_the_text(size):
    raw = bytes(i * 7 % 251 for i in range(size))
    whole, low, high = quality.ratios(raw, quality.Bands(), zstandard.ZstdCompressor(level=3))
    assert (size == 0) == (whole == 0.0) and low <= high
