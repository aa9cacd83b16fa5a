"""XLIFF: what is read, and what merges and exports give back."""

import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import language
from weftline.sources import xliff

DEEP = "".join(f'<pc id="{i}">' for i in range(60)) + "core" + "</pc>" * 60
TWO = f"""<?xml version="1.0" encoding="UTF-8"?>\r
<!-- a comment with <source>no</source> -->\r
<xliff xmlns="urn:oasis:names:tc:xliff:document:2.0" xmlns:m="urn:m" version="2.1" srcLang="en" trgLang="de">\r
 <file id="f"><notes><note id="1">Keep <![CDATA[<this>]]></note></notes>\r
  <unit id="deep"><m:matches><m:match><source>aside</source><target>beiseite</target></m:match></m:matches>\r
   <originalData><data id="d1">&lt;b&gt;</data></originalData>\r
   <segment id="s1" state="initial">\r
    <source>a {DEEP} &amp; &#233;⟦x⟧ b</source>\r
   </segment>\r
   <ignorable><source> </source></ignorable>\r
   <segment><source>one<cp hex="001A"/><ph id="p1" dataRef="d1"/> <sc id="q"/>two<ec startRef="q"/> <sc id="open"/></source><target>eins</target></segment>\r
   <segment><source><mrk id="m1" type="term">term</mrk> <g/> x</source><target/></segment>\r
  </unit>\r
  <group translate="no"><unit id="no"><segment><source>stays</source></segment></unit>\r
   <unit id="yes" translate="yes"><segment><source>goes</source><target>geht</target></segment></unit></group>\r
 </file></xliff>\r
"""
ONE = """<xliff version="1.2"><file source-language="en"><body>
  <trans-unit id="1"><source>Press <g id="1" ctype="bold">the <x id="2"/></g> <bpt id="3">&lt;i></bpt>key<ept id="3">&lt;/i></ept></source>
    <alt-trans><source>Press</source><target>Drück</target></alt-trans></trans-unit>
  <trans-unit id="2"><source>A. B.</source><seg-source><mrk mtype="seg" mid="a">A.</mrk> <mrk mtype="seg" mid="b">B.</mrk></seg-source></trans-unit>
  <trans-unit id="3"><source>C. D.</source><seg-source><mrk mtype="seg" mid="0">C.</mrk> <mrk mtype="seg" mid="1">D.</mrk></seg-source><target><mrk mtype="seg" mid="0">Ce.</mrk> <mrk mtype="seg" mid="1">De.</mrk></target></trans-unit>
</body></file></xliff>"""


def told(text):
    return {(s.unit, s.segment): (s.source.tagged, s.target.tagged if s.target else None) for s in xliff.segments(text) if s.translate}


def test_what_is_read():
    two = told(TWO)
    opening, closing = "".join(f"⟦{i}⟧" for i in range(60)), "".join(f"⟦/{i}⟧" for i in reversed(range(60)))
    assert two == {
        ("deep", "s1"): (f"a {opening}core{closing} & é⟦⟦x⟧⟧ b", None),
        ("deep", "2"): ("one⟦cp001A/⟧⟦p1/⟧ ⟦q⟧two⟦/q⟧ ⟦open/⟧", "eins"),
        ("deep", "3"): ("⟦m1⟧term⟦/m1⟧ ⟦c3⟧⟦/c3⟧ x", ""),
        ("yes", "1"): ("goes", "geht"),
    }
    assert told(ONE) == {
        ("1", "1"): ("Press ⟦1⟧the ⟦2/⟧⟦/1⟧ ⟦3⟧key⟦/3⟧", None), ("2", "a"): ("A.", None), ("2", "b"): ("B.", None), ("3", "0"): ("C.", "Ce."), ("3", "1"): ("D.", "De."),
    }


@pytest.mark.parametrize("text", [TWO, ONE])
def test_a_merge_without_changes_gives_every_byte_back(text):
    for changes in ({}, {k: t for k, (_, t) in told(text).items() if t is not None}, {("none", "1"): "x"}):
        assert xliff.merge_file(text, changes) == (text, 0, 0)


@pytest.mark.parametrize("text", [TWO, ONE])
def test_pseudo_translations_are_read_back_and_nothing_else_changes(text):
    changes = {k: source.translate(language.PSEUDO) if "⟦" not in source else "ü " + source for k, (source, _) in told(text).items()}
    merged, n, refused = xliff.merge_file(text, changes)
    assert (n, refused) == (len(changes), 0)
    after = told(merged)
    assert {k: t for k, (_, t) in after.items()} == changes and {k: s for k, (s, _) in after.items()} == {k: s for k, (s, _) in told(text).items()}
    bare = lambda x: re.sub(r"\s*<target[^>]*/>|\s*<target>(?:(?!</target>).)*</target>", "", x, flags=re.S)
    assert bare(merged) == bare(text)
    assert xliff.merge_file(merged, changes) == (merged, 0, 0)


def test_new_targets_keep_indents_prefixes_and_markup():
    merged, _, _ = xliff.merge_file(TWO, {("deep", "s1"): "<⟦0⟧K⟦/0⟧ & ⟦⟦⟧⟧>"})
    assert '</source>\r\n    <target>&lt;<pc id="0">K</pc> &amp; ⟦⟧&gt;</target>\r\n   </segment>' in merged
    prefixed = '<x:xliff version="2.0"><x:file><x:unit id="1"><x:segment><x:source>a<x:ph id="1" disp="a>b"/></x:source></x:segment></x:unit></x:file></x:xliff>'
    assert '</x:source><x:target><x:ph id="1" disp="a>b"/>b</x:target>' in xliff.merge_file(prefixed, {("1", "1"): "⟦1/⟧b"})[0]
    part, n, _ = xliff.merge_file(ONE, {("2", "b"): "Be."})
    assert n == 1 and '</seg-source><target><mrk mtype="seg" mid="a"></mrk><mrk mtype="seg" mid="b">Be.</mrk></target>' in part


def test_targets_with_other_codes_are_refused():
    for bad in ("⟦9/⟧", "⟦1⟧x⟦/2⟧", "⟦ alone"):
        assert xliff.merge_file(ONE, {("1", "1"): bad}) == (ONE, 0, 1)


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file long, text string")


def test_files_on_spark(spark):
    df = files(spark, TWO, ONE, "<xliff><unit></xliff>", None, "")
    assert [r.file for r in xliff.faults(df, ["file"], "text").collect()] == [2]
    units = xliff.read(df, ["file"], "text")
    assert units.where("translate").count() == len(told(TWO)) + len(told(ONE))
    rows = xliff.merge(df, ["file"], "text", units.select("file", "id", "segment", F.concat(F.lit("→"), "source").alias("target"))).collect()
    got = {r.file: r for r in rows}
    assert (got[0].written, got[1].written, got[2].written, got[2].text) == (4, 5, 0, "<xliff><unit></xliff>") and got[2].error and got[3].text is None
    assert told(got[1].text)["1", "1"][1] == "→Press ⟦1⟧the ⟦2/⟧⟦/1⟧ ⟦3⟧key⟦/3⟧"


def test_exports_are_read_and_merged_back(spark):
    rows = [(1, i, f'u"{i}', s, t) for i, (s, t) in enumerate([("a & <b> ⟦1⟧x⟦2⟧y⟦/1⟧z⟦/2⟧ ⟦p/⟧", None), ("⟦⟦q⟧⟧", "⟦⟦k⟧⟧ & co"), ("", ""), ("line\r\nbreak", "Zeile\r")])]
    units = spark.createDataFrame(rows, "file long, n long, id string, source string, target string")
    out = xliff.export(units, ["file"], "en", "de")
    back = {r.id: (r.source, r.target) for r in xliff.read(out, ["file"], "text").collect()}
    assert back == {u: (s, t or None) for _, _, u, s, t in rows}
    changed = xliff.merge(out, ["file"], "text", units.select("file", "id", F.lit("1").alias("segment"), F.col("source").alias("target")))
    assert {r.id: r.target for r in xliff.read(changed, ["file"], "text").collect()} == {u: s or None for _, _, u, s, _ in rows}


def test_a_file_of_many_units_is_read_and_merged_in_one_go():
    """Every unit without a target looks for its indent, and no longer in all that stands before it."""
    n = 40_000
    body = "".join(f'\n  <trans-unit id="{i}"><source>word {i} &amp; more</source></trans-unit>' for i in range(n))
    text = f'<xliff version="1.2"><file><body>{body}</body></file></xliff>'
    begun = time.process_time()
    made, written, _ = xliff.merge_file(text, {(str(i), "1"): "neu" for i in range(0, n, 2)})
    assert time.process_time() - begun < 60  # its time grew with the square of the file before
    assert written == n // 2 and [s.target and s.target.tagged for s in xliff.segments(made)] == ["neu", None] * (n // 2)


def test_segments_come_before_the_file_ends():
    """A reader holds one unit, not the file's tree; a file that is not well-formed still gives nothing to ``read``."""
    units = "".join(f'<unit id="{i}"><segment><source>text {i}</source></segment></unit>' for i in range(20_000))
    broken = f'<xliff version="2.0"><file id="f" translate="no">{units}<unit>'
    first = next(iter(xliff.segments(broken)))
    assert (first.unit, first.translate) == ("0", False) and "not well-formed" in xliff.fault(broken) and not list(xliff._rows(broken))
    assert len(list(xliff._rows(broken[:-6] + "</file></xliff>"))) == 20_000
