"""License scans by ordered signature rules.

A keyword automaton passes over each text once; the regexes of the keywords found then run on the whole text. Detections
are resolved in order of priority, then length, then place: a detection inside the interval of one already accepted
is suppressed. What stays gives the labels; the score is the best confidence among them.

Base phrases (``mit license`` and so on) are counted over the words of ``letter_words``, apart from the rules.

Defined results: null and empty texts have no words, no labels and score 0; texts of any length are scanned whole;
repeated rows each get their row; detections that tie go by place, then by rule; an empty table gives no rows; other columns
are not read, so their names cannot clash; an id column with the name of a result column raises.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import check_id, letter_words, map_batches
from weftline.llm.license_rules import KINDS, RULES

BASE = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    literals: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


#: A regex is read as groups (one level deep), classes, escapes and single characters, each with its quantifier.
PART = re.compile(r"(\((?:[^()\\]|\\.|\([^()]*\))*\)|\[[^]]*\]|\\.|.)([?*+]\??|\{[\d,]+\}\??)?")


def literals(regex: str) -> tuple[str, ...]:
    """The runs of characters that every match holds, the longest first."""
    runs = [""]
    for part, times in PART.findall(regex):
        char = part[1:] if part[0] == "\\" and part[1] not in "bBdDsSwW" else part
        if len(char) == 1 and char not in " .^$" or part == r"\.":
            runs[-1] += char if not times else ""
            if times:
                runs.append(char if times[0] == "+" else "")
        else:
            runs.append("")
    return tuple(sorted(set(filter(None, runs)), key=lambda x: (-len(x), x)))


def parse_rules(text: str = RULES) -> list[Rule]:
    rules = []
    for line in filter(None, map(str.strip, text.splitlines())):
        label, kind, regex = line.split(" | ", 2)
        priority, confidence = KINDS[kind]
        rules.append(Rule(len(rules), label, literals(regex), re.compile(regex.replace(" ?", r"\W*").replace(" ", r"\W+"), re.DOTALL), priority, confidence))
    return rules


def keyword_gate(rules: list[Rule]):
    """The longest literal of each rule gates it; the other literals are looked for where it occurs."""
    gate, by_key = ahocorasick.Automaton(), {}
    for rule in rules:
        by_key.setdefault(rule.literals[0], []).append(rule)
    for key, own in by_key.items():
        gate.add_word(key, own)
    gate.make_automaton()
    return gate


def detect(text: str, rules_gate) -> list[tuple[int, int, Rule]]:
    """Accepted detections (start, end, rule) in code points, by place."""
    candidates = {rule.number: rule for _, own in rules_gate.iter(text) for rule in own}
    found = []
    for rule in candidates.values():
        if all(x in text for x in rule.literals):
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text)]
    return suppress(found)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Without detections inside an accepted one that ranks before them: higher priority, then longer, earlier, earlier rule."""
    ranked = sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].number))
    accepted = []
    # accepted intervals that contain no other can be kept with rising starts and ends: containment is one lookup
    starts, ends = [], []
    for start, end, rule in ranked:
        i = bisect.bisect_right(starts, start)
        if i and max(ends[i - 1], end) == ends[i - 1]:
            continue
        while i < len(starts) and ends[i] <= end:  # lies inside the new, longer reach
            del starts[i], ends[i]
        if i and starts[i - 1] == start:
            ends[i - 1] = end
        else:
            starts.insert(i, start)
            ends.insert(i, end)
        accepted.append((start, end, rule))
    return sorted(accepted, key=lambda d: (d[0], d[1], d[2].number))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands."""
    found, at = [], -1
    try:
        while True:
            at = words.index(b"license", at + 1)
            found += [(at - len(p) + 1, label) for p, label in BASE.items() if at >= len(p) - 1 and tuple(words[at - len(p) + 1 : at + 1]) == p]
    except ValueError:
        return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: str = RULES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (start, end, label, rule)."""
    check_id(id_col, "n_words, n_base, first_word, last_word, base_labels, labels, score, detections")
    kind = docs.schema[id_col].dataType.simpleString()

    def work():
        gate = keyword_gate(parse_rules(rules))

        def do(batch):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for text in batch.column("text").to_pylist():
                words = letter_words(text)
                places = base_places(words)
                kept = detect((text or "").encode().lower().decode(), gate)
                base = {label for _, label in places}
                first = [at for at, _ in places]
                row = (len(words), len(places), min(first, default=None), max(first, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in kept})), max((r.confidence for *_, r in kept), default=0.7 if base else 0.0), [{"start": a, "end": b, "label": r.label, "rule": r.number} for a, b, r in kept])
                for values, x in zip(out.values(), row, strict=True):
                    values.append(x)
            return out | {"id": batch.column("id")}

        return do

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,rule:int>>"
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, work).withColumnRenamed("id", id_col)
