"""JSON and YAML: pointers of every text, and writing back, over files made at random."""

import json
import random

import pytest

from weftline.sources import structured as S

STRINGS = ["plain", "two words", "", "with \"quotes\" and 'single'", "line\nbreak", "a: b", "# no", "- dash", "~", "true", "12", "ünï 日本 😀", "tab\there", "trailing ", "back\\slash", "{x}", "a, b", "x#y", "http://a.b/c:d", "nul\x00", "key/with~both", "it''s"]


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.45:
        return rng.choice([*STRINGS, 1, -2.5, True, None])
    if kind < 0.75:
        return {rng.choice(STRINGS) + str(i): made(rng, depth - 1) for i in range(rng.randint(0, 4))}
    return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def pointers(value, path=""):
    if isinstance(value, str):
        return [(path, value)]
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [x for k, v in items for x in pointers(v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")]


def test_json_of_any_shape():
    rng = random.Random(4)
    for _ in range(400):
        value = made(rng, 4)
        text = json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        found = S.json_texts(text)
        assert [(x.pointer, x.value) for x in found] == pointers(value)
        assert S.merge_file(text, dict(pointers(value)), "json") == (text, 0)
        changes = {p: rng.choice(STRINGS) for p, _ in pointers(value)}
        merged, n = S.merge_file(text, changes, "json")
        assert {x.pointer: x.value for x in S.json_texts(merged)} == changes and n == sum(changes[p] != v for p, v in pointers(value))
        rebuilt = json.loads(merged)
        assert pointers(rebuilt) == [(p, changes[p]) for p, _ in pointers(value)]


def test_json_of_great_depth():
    text = "[" * 20_000 + '"x"' + "]" * 20_000
    assert S.json_texts(text)[0].pointer == "/0" * 20_000


@pytest.mark.parametrize("text", ["", "{", '{"a" 1}', '{"a": 1,}', "[1 2]", '"a" "b"', '{"a": nul}', "[1,]", '{"a": "b\n"}', "]", '{1: 2}', "[01]"])
def test_what_is_no_json(text):
    with pytest.raises(ValueError, match="JSON"):
        S.json_texts(text)


def dumped(rng, value, indent=0):
    """YAML lines of a value in styles by chance; the first line goes behind its key or dash."""
    pad = " " * indent
    if isinstance(value, str):
        if value and rng.random() < 0.3 and value.isprintable() and not value[0].isspace() and "\n" not in value and value.strip() == value:
            return [rng.choice("|>") + "-", f"{pad}{value}"]
        if value.isprintable() and rng.random() < 0.4:
            return ["'" + value.replace("'", "''") + "'"]
        if not S.UNSAFE.search(value) and not S.NO_TEXT.fullmatch(value) and rng.random() < 0.8:
            return [value + rng.choice(["", "  # said"])]
        return [json.dumps(value)]
    if not isinstance(value, (dict, list)) or not value or (rng.random() < 0.15 and "\\u0000" not in json.dumps(value)):
        return [json.dumps(value)]
    out = [""]
    if isinstance(value, dict):
        for k, v in value.items():
            key = k if not S.UNSAFE.search(k) and "#" not in k and ":" not in k and rng.random() < 0.7 else json.dumps(k)
            first, *rest = dumped(rng, v, indent + 2)
            out += [f"{pad}{key}: {first}".rstrip(" ") if not first else f"{pad}{key}: {first}", *rest]
            out += rng.choice([[], [], [""], [f"{pad}# a comment: x"]])
    else:
        for v in value:
            first, *rest = dumped(rng, v, indent + 2)
            if isinstance(v, dict) and not first and rest and rng.random() < 0.7 and rest[0].startswith(" " * (indent + 2)):
                first, *rest = rest[0].strip(" ") if rest[0][-1] != " " else rest[0][indent + 2 :], *rest[1:]
            out += [f"{pad}- {first}" if first else f"{pad}-", *rest]
    return out


def test_yaml_of_any_shape():
    rng = random.Random(8)
    seen = set()
    for _ in range(600):
        value = made(rng, 4)
        if not isinstance(value, (dict, list)) or not value:
            continue
        text = "\n".join(dumped(rng, value)[1:] or [json.dumps(value)]) + "\n"
        found = S.yaml_texts(text)
        assert [(x.pointer, x.value) for x in found] == pointers(value), text
        seen |= {x.style for x in found}
        assert S.merge_file(text, dict(pointers(value)), "yaml") == (text, 0)
        changes = {x.pointer: rng.choice([s for s in STRINGS if x.style not in ("|", ">") or s and s.isprintable() and s.strip() == s]) for x in found}
        merged, _ = S.merge_file(text, changes, "yaml")
        assert [(x.pointer, x.value) for x in S.yaml_texts(merged)] == list(changes.items()), merged
    assert seen >= {"|", ">", '"', "'", ""}


RAILS = """\
# comment
en:
  hello: Hello   # greeting
  long: this is a
    text over lines

    and a paragraph
  quoted: "it's
    folded \\
    twice"
  lit: |
    first
      second

    third
  fold: >-
    one
    two

    three
  list:
  - a
  - - deep
    - b: c
      d: "e"
  flow: {x: y, 'k': [p, "q, r", 3], url: http://a/b}
  n: 12
  empty:
  yes: no
"""


def test_yaml_styles():
    found = {x.pointer: x.value for x in S.yaml_texts(RAILS)}
    assert found == {
        "/en/hello": "Hello", "/en/long": "this is a text over lines\nand a paragraph", "/en/quoted": "it's folded twice", "/en/lit": "first\n  second\n\nthird", "/en/fold": "one two\nthree",
        "/en/list/0": "a", "/en/list/1/0": "deep", "/en/list/1/1/b": "c", "/en/list/1/1/d": "e", "/en/flow/x": "y", "/en/flow/k/0": "p", "/en/flow/k/1": "q, r", "/en/flow/url": "http://a/b",
    }
    merged, n = S.merge_file(RAILS, {"/en/hello": "yes", "/en/lit": "x\ny", "/en/fold": "p\nq", "/en/flow/x": "1, 2", "/en/long": "short"}, "yaml")
    assert n == 5 and '  hello: "yes"   # greeting\n  long: short\n' in merged and "  lit: |\n    x\n    y\n  fold: >-\n    p\n\n    q\n" in merged and 'flow: {x: "1, 2",' in merged


@pytest.mark.parametrize(("text", "why"), [("a: &x b", "line 1: an anchor"), ("a:\n  b: *x", "line 2: an anchor"), ("a: !t b", "tag"), ("? a\n: b", "complex"), ("a: 'b", "open quote"), ("a: [b, c", "flow"), ("a:\n\t- b", "tab"), ("a: b\n  c: d", "key inside")])
def test_what_is_refused(text, why):
    with pytest.raises(ValueError, match=why):
        S.yaml_texts(text)


def test_several_documents():
    assert [(x.pointer, x.value) for x in S.yaml_texts("---\na: b\n---\n- c\n...\n")] == [("doc1/a", "b"), ("doc2/0", "c")]
    assert [(x.pointer, x.value) for x in S.yaml_texts("---\na: b\n")] == [("/a", "b")]


def test_on_spark(spark):
    df = spark.createDataFrame([(1, '["x", {"a": ["y"]}]'), (2, "[1"), (3, None)], "file long, text string")
    assert [tuple(r) for r in S.read(df, ["file"], "text", "json").orderBy("n").collect()] == [(1, 0, "/0", "x"), (1, 1, "/1/a/0", "y")]
    assert [r.file for r in S.faults(df, ["file"], "text", "json").collect()] == [2]
    changes = spark.createDataFrame([(1, "/1/a/0", "z"), (2, "/0", "q"), (1, "/none", "q")], "file long, pointer string, value string")
    got = {r.file: (r.text, r.written, bool(r.error)) for r in S.merge(df, ["file"], "text", "json", changes).collect()}
    assert got == {1: ('["x", {"a": ["z"]}]', 1, False), 2: ("[1", 0, True), 3: (None, 0, False)}
    values = S.read(df, ["file"], "text", "json values").select("value")
    assert values.count() == 2 and S.json_texts('[1, true, null, "a"]', True)[1].value == "true"
