"""Tables of any width, against the csv module on files written by it."""

import csv
import io
import random

from weftline.sources import bilingual as B


def test_records_against_csv():
    rng = random.Random(3)
    cells = ["a", "", "two words", 'quo"te', '"', "line\nbreak", "a;b", "a,b", "tab\tc", "crlf\r\nx", " padded ", '""', "ünï"]
    for _ in range(500):
        rows = [[rng.choice(cells) for _ in range(rng.randint(2, 40))] for _ in range(rng.randint(1, 6))]
        sep = rng.choice(B.SEPARATORS)
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        assert B.records(out.getvalue(), sep) == rows


def test_odd_tables():
    assert B.records('a"b,c\n"open,d', ",") == [['a"b', "c"], ['"open', "d"]]
    assert B.records("a,b,", ",") == [["a", "b", ""]] and B.records("", ",") == []
    assert B.separator_of('"x, y, z";b\n1;2') == ";" and B.separator_of("a|b|c\n") == "|" and B.separator_of("a") == ","


def test_wide_tables(spark):
    head = ",".join([f"h{i}" for i in range(180)] + ["Source", "Target"])
    row = ",".join([f"v{i}" for i in range(180)] + ["says ⟦x", '"both\nlines"'])
    df = spark.createDataFrame([(1, f"{head}\n{row}\n"), (2, "eins;one\n;none\n"), (3, None), (4, "")], "file int, text string")
    got = {tuple(r) for r in B.table_pairs(df, ["file"], "text").collect()}
    assert got == {(1, 1, "says ⟦⟦x", "both\nlines"), (2, 0, "eins", "one")}


def test_paired_documents(spark):
    df = spark.createDataFrame([(1, "One is here. Two is there. Three is [gone].", "Eins ist hier. Zwei ist dort. Drei ist [weg].")], "file int, a string, b string")
    got = B.document_pairs(df, ["file"], "a", "b").orderBy("n").collect()
    assert [r.source for r in got] == ["One is here.", "Two is there.", "Three is [gone]."] and got[0].target == "Eins ist hier." and "Drei ist [weg]." in got[2].target


def test_a_long_table_does_not_carry_its_file_along(spark):
    """Rows leave the reader one by one: exploded from an array, each row copied all of its file's rows."""
    text = "Source;Target\n" + "".join(f"word {i};Wort {i}\n" for i in range(5000))
    got = B.table_pairs(spark.createDataFrame([(1, text), (2, text)], "file int, text string"), ["file"], "text")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 10_000 and got.where("source = 'word 4999' and target = 'Wort 4999' and n = 5000").count() == 2
