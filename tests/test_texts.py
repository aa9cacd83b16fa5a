"""Messages, placeholders, numbers, dates and plurals, on cases of any depth and size."""

import datetime
import hashlib
import hmac
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import dates, language, messages, rules
from weftline.functions import text as T


def nested(depth):
    out = "{leaf}"
    for i in range(depth):
        out = f"{{a{i}, select, yes {{{out} it''s}} other {{no '{{'x'}}'}}}}"
    return out


def test_messages_of_any_depth():
    for depth in (1, 3, 400):
        parts = messages.parse(nested(depth))
        assert "".join(p.text for p in parts) == nested(depth)
        assert messages.skeleton(parts) == [(f"a{i}", "select", ("other", "yes")) for i in reversed(range(depth))]
        assert messages.arguments(parts) == {("leaf", "")} | {(f"a{i}", "select") for i in range(depth)}


def test_a_plural_inside_a_select():
    source = "{g, select, f {{n, plural, one {{x} of # her} other {# of her}}} other {none}}"
    assert messages.arguments(messages.parse(source)) == {("g", "select"), ("n", "plural"), ("x", "")}
    assert messages.problems(source, source) == []
    assert messages.problems(source, "{n, plural, one {{x}} other {#}}") == ["icu_argument_missing"]
    assert messages.problems(source, source.replace("other {none}", "")) == ["icu_no_other", "icu_selectors_changed"]
    assert messages.problems(source, source.replace("{n, plural", "{n, selectordinal")) == ["icu_type_changed"]
    assert messages.problems(source, source.replace("one {", "one {few {")) == ["icu_argument"]
    assert messages.problems("100 % { not a message", "anything") == []


@pytest.mark.parametrize(("text", "want"), [
    ("it''s {a}", [("text", "it''s "), ("argument", "{a}")]),
    ("'{quoted}' {b, number, ::currency/{x}}", [("text", "'{quoted}' "), ("argument", "{b, number, ::currency/{x}}")]),
    ("{d, date, 'of the }' MMM}x", [("argument", "{d, date, 'of the }' MMM}"), ("text", "x")]),
    ("{n, plural, offset:1 =0 {none} other {#}}", [("open", "{n, plural, offset:1 =0 {"), ("text", "none"), ("next", "} other {"), ("text", "#"), ("close", "}}")]),
    ("", []),
])
def test_parts(text, want):
    assert [(p.kind, p.text) for p in messages.parse(text)] == want


@pytest.mark.parametrize(("text", "wrong"), [("{a", "unbalanced"), ("a}", "unbalanced"), ("{n, plural, one {x}", "unbalanced"), ("{n, plural, }", "argument"), ("{}", "argument"), ("{a b}", "argument"), ("{n, plural, one {x} y}", "argument")])
def test_what_is_no_message(text, wrong):
    with pytest.raises(messages.MessageError, match=wrong):
        messages.parse(text)


def test_protect_and_restore_give_the_value_back():
    rng = random.Random(5)
    pieces = ["{n, plural, one {# ", "} other {", "}}", "{x}", "'{'", "⟦", "⟧", "⟦3/⟧", "text ", "%s", "%1$d", "{{name}}", "${v}", "%{who}", "''", "#", "{", "}"]
    for _ in range(3000):
        value = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        tagged, codes = messages.protect(value)
        assert messages.restore(tagged, codes) == value
        bare = re.sub(r"⟦\d+/⟧", "", tagged.replace("⟦⟦", "").replace("⟧⟧", ""))
        assert not re.search("[⟦⟧]", bare)
    assert messages.protect("{n, plural, one {# day} other {# days}} {who}")[0] == "⟦1/⟧# day⟦2/⟧# days⟦3/⟧ ⟦4/⟧"
    assert messages.restore("⟦7/⟧", ["a"]) is None and messages.restore("⟧ ⟦1/⟧", ["a"]) is None


def test_placeholder_forms():
    forms = {
        "mustache": ["{{name}}", "{{ a.b }}", "{{{raw}}}", "{{#each x}}"], "template literal": ["${total}", "${a[0]}"], "ruby": ["%{who}", "%<n>"], "python": ["%(name)s", "%(n)d"],
        "format": ["{0}", "{user.name}"], "printf": ["%s", "%d", "%1$s", "%.2f", "%-5d", "%05.1f", "%lld", "%hhu", "%@", "%2$@", "%*d"],
    }
    assert forms.keys() == T.PLACEHOLDERS.keys()
    for form, examples in forms.items():
        for x in examples:
            assert re.fullmatch(T.PLACEHOLDERS[form], x) and re.findall(T.PLACEHOLDER, f"a {x}, b") == [x]
    assert re.findall(T.PLACEHOLDER, "100 % der Teile, 50% mehr, {}, { a, b }") == []


def best_matching(a, b):
    """By all ways of giving each number at most one partner."""
    if not a:
        return 0
    return max([best_matching(a[1:], b), *(1 + best_matching(a[1:], b[:j] + b[j + 1 :]) for j, y in enumerate(b) if a[0] & y)])


def test_number_matching_against_all_ways():
    rng = random.Random(1)
    tokens = ["1.000", "1000", "1,0", "1", "2,500", "2.5", "2500", "7"]
    for _ in range(300):
        a, b = ([language.readings(rng.choice(tokens)) for _ in range(rng.randint(0, 5))] for _ in range(2))
        n = best_matching(a, b)
        assert language.unmatched(a, b) == (len(a) - n, len(b) - n)


def test_many_equal_numbers():
    five, other = language.readings("5"), [language.readings(str(i)) for i in range(3000)]
    assert language.unmatched([five] * 12_000, [five] * 11_999) == (1, 0)
    assert language.unmatched([five] * 9_000 + other, other[:2990] + [five] * 9_005) == (10, 5)


@pytest.mark.parametrize(("token", "values"), [("1.234", {1.234, 1234}), ("1.234.567", {1234567}), ("1.234,5", {1234.5}), ("1,234.5", {1234.5}), ("1.23.4", {123.4}), ("1,234,567.8", {1234567.8}), ("12", {12}), ("0,5", {0.5}), ("1.000,000.5", {1000000.5})])
def test_readings_of_marks(token, values):
    assert {float(v) for v in language.readings(token)} == values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("size", [1, 63, 64, 65, 640])
def test_signatures_with_keys_of_any_length(spark, size):
    secret = bytes(i % 251 for i in range(size))
    assert one(spark, T.signature(secret, F.lit(12), F.lit("body"))) == hmac.new(secret, b"12.body", hashlib.sha256).hexdigest()


def test_phrases_on_every_weekday(spark):
    week = [datetime.date(2026, 3, 2) + datetime.timedelta(days=i) for i in range(7)]  # from a Monday on
    friday = lambda d: d + datetime.timedelta(days=(4 - d.weekday()) % 7)
    later = lambda d, n: d + datetime.timedelta(days=n)
    rules_ = {
        "by Friday": friday, "before friday, please": friday, "do petka": friday, "next week": lambda d: later(friday(d), 7), "sledeće nedelje": lambda d: later(friday(d), 7),
        "end of the week": friday, "this week": friday, "within 5 days": lambda d: later(d, 5), "za 3 dana": lambda d: later(d, 3), "in 2 weeks": lambda d: later(d, 14),
        "on monday": lambda d: later(d, -d.weekday() % 7), "u sredu": lambda d: later(d, (2 - d.weekday()) % 7), "danas": lambda d: d, "Sutra": lambda d: later(d, 1),
        "on 30.2.": lambda d: None, "5.3.": lambda d: datetime.date(2026 if d.day <= 5 else 2027, 3, 5), "5.3.2020": lambda d: datetime.date(2020, 3, 5), "2026-13-01": lambda d: None, "whenever": lambda d: None,
    }
    rows = spark.createDataFrame([(p, d) for p in rules_ for d in week], "p string, d date")
    for r in rows.select("p", "d", dates.relative_date(F.col("p"), F.col("d")).alias("x")).collect():
        assert r.x == rules_[r.p](r.d), (r.p, r.d)


def test_plural_tables(spark):
    rows = {r.lang: r for r in rules.plural_table(spark).collect()}
    assert len(rows) == 64 and all(list(r.categories) == sorted(r.categories, key=rules.CATEGORIES.index) and r.categories[-1] == "other" for r in rows.values())
    assert rows["cs"].required == ["one", "few", "other"] and rows["ru"].required == ["one", "few", "many", "other"] and rows["ru"].gettext == ["one", "few", "many"] and rows["sl"].gettext == rows["sl"].required
    tags = spark.createDataFrame([("sr-Latn-RS",), ("tlh",), (None,), ("PT_br",)], "tag string")
    got = {r.tag: r.required for r in rules.plural_forms(tags, "tag").collect()}
    assert got == {"sr-Latn-RS": ["one", "few", "other"], "tlh": ["one", "other"], None: ["one", "other"], "PT_br": ["one", "other"]}
    forms = list(itertools.chain(["=0", "one"], rules.CATEGORIES))
    assert [one(spark, rules.source_form(F.lit(c), F.lit(["one", "other"]))) for c in forms] == [None, "one", "other", "one", "other", "other", "other", "other"]


def test_word_similarity_against_all_stretches(spark):
    rng = random.Random(6)
    words = ["ab", "abc", "bca", "cab", "a", "abcab", "çok", "x1"]
    made = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [("word", "two words"), (None, "x"), ("x", None), ("", "x"), *((made(3), made(9)) for _ in range(200))]
    df = spark.createDataFrame(rows, "q string, x string").select("q", "x", language.word_similarity("q", "x").alias("s"))
    assert one(spark, T.trigram_sequence(F.lit("Two wörds_2"))) == language.trigrams_in_order("Two wörds_2")

    def grams(text):
        return [w[i : i + 3] for w in (f"  {w} " for w in re.findall(r"[^\W_]+", text.lower())) for i in range(len(w) - 2)]

    for r in df.collect():
        if r.q is None or r.x is None:
            assert r.s is None
            continue
        q, g = set(grams(r.q)), grams(r.x)
        want = max([len(q & set(g[a:b])) / len(q | set(g[a:b])) for a in range(len(g)) for b in range(a + 1, len(g) + 1) if q] or [0.0])
        assert abs(r.s - want) < 1e-12, r
    assert df.first().s == 0.8
