"""Catalogues by hand in every form, files of unknown form, rows that are hard to write."""

import pytest

from weftline.sources import catalogues

FILES = {
    "flat.json": ('{"a.b": "x", "n": {"one": "1", "other": "2"}}', "json", [("a.b", None, None, "x"), ("n", "one", None, "1"), ("n", "other", None, "2")]),
    "deep.json": ('{"a": {"b": "x", "one": "y"}}', "json_nested", [("a.b", None, None, "x"), ("a.one", None, None, "y")]),
    "i18.json": ('{"cart_one": "1", "cart_other": "2", "step_two": "no family"}', "i18next", [("cart", "one", None, "1"), ("cart", "other", None, "2"), ("step_two", None, None, "no family")]),
    "fj.json": ('{"hi": {"defaultMessage": "Ciao", "description": "greets"}}', "formatjs", [("hi", None, None, "Ciao")]),
    "app.json": ('{"@@locale": "it", "hi": "Ciao", "@hi": {"description": "d"}}', "arb", [("hi", None, "it", "Ciao")]),
    "cat.json": ('{"sourceLanguage": "en", "strings": {"k": {"localizations": {"de": {"variations": {"plural": {"one": {"stringUnit": {"value": "%d Tag"}}, "other": {"stringUnit": {"value": "%d Tage"}}}}}, "fr": {"stringUnit": {"value": "jour"}}}}}}', "xcstrings", [("k", "one", "de", "%d Tag"), ("k", "other", "de", "%d Tage"), ("k", None, "fr", "jour")]),
    "strings.xml": ("<resources><!-- <string name='no'>x</string> --><string name=\"a\">It\\'s &lt;b&gt; \\n</string><plurals name=\"d\"><item quantity=\"one\">day</item>\n<item quantity=\"other\">days</item></plurals></resources>", "android", [("a", None, None, "It's <b> \n"), ("d", "one", None, "day"), ("d", "other", None, "days")]),
    "L.strings": ('/* "no" = "no"; */\n"a" = "say \\"x\\"";', "strings", [("a", None, None, 'say "x"')]),
    "en.yml": ("en:\n  a: x\n  day:\n    one: day\n    other: days\n", "yaml", [("a", None, "en", "x"), ("day", "one", "en", "day"), ("day", "other", "en", "days")]),
    "de.po": ('msgid ""\nmsgstr "head"\n\nmsgctxt "menu"\nmsgid "Open"\nmsgstr "Öff"\n"nen"\n\nmsgid "day"\nmsgid_plural "days"\nmsgstr[0] "Tag"\nmsgstr[1] "Tage"\n', "po", [("menu\u0004Open", None, None, "Öffnen"), ("day", "one", None, "Tag"), ("day", "other", None, "Tage")]),
    "m.pot": ('msgid "Open"\nmsgstr ""\n', "pot", [("Open", None, None, "Open")]),
    "a.xlf": ('<xliff version="1.2"><file><body><trans-unit id="k[one]"><source>a</source></trans-unit></body></file></xliff>', "xliff12", [("k", "one", None, "a")]),
    "b.xliff": ('<xliff version="2.0"><file id="f"><unit id="k"><segment><source>a</source><target>⟦b⟧</target></segment></unit></file></xliff>', "xliff21", [("k", None, None, "⟦b⟧")]),
    "t.csv": ('Key;de;en\nk;"a;\nb";c\n', "csv", [("k", None, "de", "a;\nb"), ("k", None, "en", "c")]),
    "readme.md": ("# x", None, []),
    "none": ("{}", None, []),
    "null.json": (None, "json", []),
    "list.json": ('["x"]', "json", [("0", None, None, "x")]),
}


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_forms_by_name_and_content(spark):
    rows = spark.createDataFrame([(n, t) for n, (t, _, _) in FILES.items()], "name string, text string")
    told = {r.name: r.form for r in rows.select("name", catalogues.detect(rows.name, rows.text).alias("form")).collect()}
    assert told == {n: form for n, (_, form, _) in FILES.items()}
    got = {}
    for r in catalogues.read_named(rows.select(rows.name.alias("file"), rows.name.alias("title"), "text"), ["file"], "title", "text").collect():
        got.setdefault(r.file, []).append((r.key, r.category, r.lang, r.value))
        assert r.form == FILES[r.file][1]
    for n, (_, _, want) in FILES.items():
        assert ordered(got.get(n, [])) == ordered(want), n


HARD = [("plain", None, "x"), ("space key", None, " lead, trail "), ("e", None, ""), ("q", None, 'a "b" \'c\' \\n \\ {d} %s'), ("lines", None, "1\n2\tz"), ("x & <y>", None, "&amp; <b>é</b> ]]>"), ("a", None, "both"), ("a.b", None, "inner"), ("p", "one", "1\\"), ("p", "few", "2"), ("p", "other", "∞ 𝄞")]


@pytest.mark.parametrize("form", [f for f in catalogues.FORMS if f not in ("stringsdict", "pot")])
def test_what_is_written_is_read(spark, form):
    rows = spark.createDataFrame([(1, i, k, c, "pl", v) for i, (k, c, v) in enumerate(HARD)], "file int, n int, key string, category string, lang string, value string")
    text = catalogues.render(rows, ["file"], form, ["n"])
    if form == "po":
        got = catalogues._read_gettext(text, ["file"], "text", ("one", "few", "other")).collect()
    else:
        got = catalogues.read(text, ["file"], "text", form).collect()
    want = [(k, c, v) for k, c, v in HARD]
    if form.startswith("xliff"):  # an empty target is none, and the source stands for it
        want = [(k, c, v or k) for k, c, v in want]
    assert ordered((r.key, r.category, r.value) for r in got) == ordered(want)
    assert {r.lang for r in got} <= {"pl", None}
