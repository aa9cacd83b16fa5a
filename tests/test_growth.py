"""Operators that count no more than they need, against plain versions that count all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import weftline.plans  # noqa: F401
from weftline.operators import imports, intervals, memory, steps
from weftline.plans import registry
from weftline.sources import catalogues, memories


def plain_terms(docs, most, least, limit):
    counts = Counter()
    for key, words in docs:
        counts.update((key, tuple(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1))
    counts = {r: c for r, c in counts.items() if c >= least}
    longer = {}
    for (key, run), c in counts.items():
        for part in (run[:-1], run[1:]):
            longer[key, part] = max(longer.get((key, part), 0), c)
    kept = {}
    for (key, run), c in counts.items():
        if longer.get((key, run), 0) < c:
            kept.setdefault(key, []).append((-c * (1 + 0.5 * (len(run) - 1)), " ".join(run), c))
    return {(key, term, c, i + 1) for key, found in kept.items() for i, (_, term, c) in enumerate(sorted(found)[:limit])}


@pytest.mark.parametrize(("most", "least", "limit"), [(3, 2, 5), (2, 3, 3), (4, 2, 2), (1, 2, 4)])
def test_terms_of_any_shape(spark, most, least, limit):
    """Words that always stand together, keys with few words, texts of one word: the first runs are those of a full count."""
    rng = random.Random(most * 10 + limit)
    docs = [(k, sum(([w, w + "'", w + '"'] if w < "d" else [w] for w in rng.choices("abcdefghijklmnopqrstuvwxyz"[: 3 + 11 * k], range(3 + 11 * k, 0, -1), k=rng.randint(0, 40))), [])) for k in (0, 1, 2) for _ in range(30)]
    df = spark.createDataFrame(docs, "k int, w array<string>")
    got = memory.extract_terms(df, F.col("w"), ["k"], most, least, limit)
    assert {tuple(r) for r in got.select("k", "term", "freq", "rank").collect()} == plain_terms(docs, most, least, limit)


def test_few_runs_of_rare_words_are_counted(spark, monkeypatch):
    """Every run of three words was counted; of runs that can't be among the first none is."""
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(20_000)]
    tables = []
    written = steps.written
    monkeypatch.setattr(steps, "written", lambda df: tables.append(written(df)) or tables[-1])
    got = memory.extract_terms(spark.createDataFrame([(1, words)], "k int, w array<string>"), F.col("w"), ["k"], limit=5)
    assert {tuple(r) for r in got.select("k", "term", "freq", "rank").collect()} == plain_terms([(1, words)], 3, 2, 5)
    assert sum(t.count() for t in tables[2:]) < 200


@pytest.mark.parametrize(("hot", "counted"), [(1 / 1000, 4_000_000), (0.2, 50), (2, 10)])
def test_dice_of_hot_and_rare_words(spark, monkeypatch, hot, counted):
    """Every two words of a pair became a row to shuffle; now only those that can be alike meet, the rare ones as lists, in tasks of a bounded number of pairs."""
    monkeypatch.setattr(memory, "HOT", hot)
    monkeypatch.setattr(memory, "COUNTED", counted)
    rng = random.Random(5)
    some = lambda c, n: [f"{c}{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, n))]
    pairs = [(1, some("s", 12), some("t", 20)) for _ in range(150)] + [(1, ["s1", "s2"], ["t1", "t90"])] * 20 + [(2, None, ["t1"]), (2, ["s1"], None)]
    m, f, c = Counter(), Counter(), Counter()
    for _, a, b in pairs:
        m.update(set(a or ()))
        f.update(set(b or ()))
        c.update((s, t) for s in set(a or ()) for t in set(b or ()))
    want = {}
    for (s, t), n in c.items():
        if 2 * n / (m[s] + f[t]) >= 0.2:
            want.setdefault(s, []).append((-2 * n / (m[s] + f[t]), -n, t))
    df = spark.createDataFrame(pairs, "key int, a array<string>, b array<string>")
    got = memory.dice(df, "a", "b")
    assert {(r.s, r.t, r.c, r.dice) for r in got.collect()} == {(s, t, -n, -d) for s, found in want.items() for d, n, t in sorted(found)[:3]}
    assert memory.dice(df.limit(0), "a", "b").count() == 0


def test_units_of_an_import_are_read_once(spark):
    """Units were parsed anew for each pass over their pairs: counts, cuts, ends of ranges, actions, what was left out."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    text = "<tmx><header srclang='en'/><body>" + "".join(f"<tu><tuv xml:lang='en'><seg>s{i % 3}</seg></tuv><tuv xml:lang='de'><seg>t{i}</seg></tuv></tu>" for i in range(10)) + "</body></tmx>"
    units = memories.units(spark.createDataFrame([(1, text)], "file long, text string"), ["file"], "text").withColumn("source", seen("source"))
    changes, told = imports.import_units(imports.entries(spark), units, ["file"], ["file", "n"], "owner")
    assert [tuple(r) for r in told.collect()] == [(1, 10, 0, 0)] and {(r.source, r.target) for r in changes.collect()} == {("s0", "t9"), ("s1", "t7"), ("s2", "t8")}
    assert read.value == 10


@pytest.mark.parametrize("name", ["f24_d81_icu_checks", "f24_protect_restore", "j17_f17_number_matching"])
def test_a_small_table_with_costly_rows_is_spread(spark, sf_dir, name):
    """A table of one small file was one task's work, whatever its rows took."""
    assert registry.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == 4


def test_overlaps_carry_no_row_four_times(spark, monkeypatch):
    """Each span became four points with the whole span, in as many tasks as the session says; now the tasks follow the spans, and equal spans stay apart."""
    monkeypatch.setattr(intervals, "POINTS", 50)
    rng = random.Random(3)
    spans = [(i, rng.randint(0, 3), a := rng.randint(0, 40), a + rng.choice([0, 0, 1, 5, 30])) for i in range(400)]
    spans += [(400, 9, 1, 4), (400, 9, 1, 4)]
    df = spark.createDataFrame(spans, "id int, k int, a int, b int")
    got = intervals.overlap_counts(df, ["k"], "a", "b", "n")
    want = Counter((i, sum(k == l and a < d and c < b for j, (_, l, c, d) in enumerate(spans) if j != at)) for at, (i, k, a, b) in enumerate(spans))
    assert got.columns == ["id", "k", "a", "b", "n"] and Counter((r.id, r.n) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() == 16
    assert intervals.overlap_counts(df.limit(0), ["k"], "a", "b", "n").count() == 0


@pytest.mark.parametrize("form", catalogues.FORMS)
def test_files_are_written_and_read_once(spark, form):
    """Families were joined as a table: files were written and read for it again, and it went through the driver where its estimate was small."""
    rows = spark.createDataFrame([(f, k, c, v) for f in (1, None) for k, c, v in [("a", None, "x"), ("p", "one", "1"), ("p", "other", "2")]] + [(2, "p", None, "y")], "file int, key string, category string, value string")
    files = catalogues.render(rows.withColumn("lang", F.lit("de")), ["file"], form)
    found = catalogues.read(files.where(catalogues.detect(F.lit(f"app.{catalogues.FORMS[form].extension}"), F.col("text")).isNotNull()), ["file"], "text", form)
    plan = found._jdf.queryExecution().executedPlan().toString()
    writers = [line for line in plan.splitlines() if "ArrowEvalPython" in line and "array_sort(" in line]
    assert "Join" not in plan and "Broadcast" not in plan
    assert len(writers) == (2 if form == "android" else 1)  # its texts and its families are two passes
    alone = "other" if form == "stringsdict" else None
    assert {(r.file, r.key, r.category) for r in found.collect()} == {(f, k, c or alone) for f in (1, None) for k, c in [("a", None), ("p", "one"), ("p", "other")]} | {(2, "p", alone)}
