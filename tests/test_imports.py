"""Imports into a memory: codes over a unit, accounts, reviewed work, batches with a stop, a hot key."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import imports, prefix
from weftline.sources import memories

HEAD, TAIL = '<?xml version="1.0"?><tmx version="1.4"><header srclang="en-US"/><body><!-- <tu>no</tu> -->', "</body></tmx>"
UNITS = [
    '<tu><tuv xml:lang="en-US"><seg>Turn <bpt i="7">{b}</bpt>left<ept i="7">{/b}</ept> here<ph x="3">{br}</ph></seg></tuv>'
    '<tuv xml:lang="it-IT"><seg>Qui <bpt i="7"/>a sinistra<ept i="7"/><ph x="3"/></seg></tuv>'
    '<tuv lang="sr-Latn"><seg><ph x="3"/>Ovde <bpt i="7"/>levo<ept i="7"/></seg></tuv></tu>',
    '<tu><prop type="x-context"> abc </prop><tuv xml:lang="en"><seg>A ⟦mark⟧ <hi>there<it pos="end">x</it></hi>.</seg></tuv><tuv xml:lang="de"><seg>Eine ⟦Marke⟧ <hi>da</hi>.<sub>no</sub></seg></tuv></tu>',
    '<tu tuid="4"><tuv xml:lang="en-US"><seg>Alone</seg></tuv></tu>',
    '<tu><tuv xml:lang="fr"><seg>Bonjour</seg></tuv><tuv xml:lang="de"><seg>Hallo</seg></tuv></tu>',
]


def files(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file long, text string")


def brought(memory, units, rights="owner"):
    changes, told = imports.import_units(memory, units, ["file"], ["file", "n"], rights)
    return changes, {r.file: (r.imported, r.skipped, r.errors) for r in told.collect()}


def test_codes_accounts_and_reviewed_work(spark):
    units = memories.units(files(spark, HEAD + "\n".join(UNITS) + TAIL), ["file"], "text")
    changes, told = brought(imports.entries(spark), units)
    assert told == {0: (3, 1, 1)}
    got = {(r.target_lang, r.context): (r.source, r.target) for r in changes.collect()}
    turn = "Turn ⟦1⟧left⟦/1⟧ here⟦2/⟧"
    assert got == {
        ("it-it", None): (turn, "Qui ⟦1⟧a sinistra⟦/1⟧⟦2/⟧"),
        ("sr-latn", None): (turn, "⟦2/⟧Ovde ⟦1⟧levo⟦/1⟧"),
        ("de", "abc"): ("A ⟦⟦mark⟧⟧ ⟦1⟧there⟦/2⟧⟦/1⟧.", "Eine ⟦⟦Marke⟧⟧ ⟦1⟧da⟦/1⟧."),
    }
    # a reviewer changes one; the same file again brings nothing
    memory = changes.withColumn("target", F.when(F.col("target_lang") == "it-it", "Svolta").otherwise(F.col("target")))
    memory = memory.withColumn("origin", F.when(F.col("target_lang") == "it-it", "review").otherwise("import")).withColumn("status", F.when(F.col("target_lang") == "it-it", "approved").otherwise("imported"))
    again, told = brought(memory, units)
    assert told == {0: (0, 4, 1)} and again.count() == 0
    with pytest.raises(ValueError, match="rights"):
        brought(memory, units, "  ")


def test_odd_files(spark):
    rows = files(spark, None, "", HEAD + '<tu/><tu a="1"/><tu><tuv xml:lang="en"><seg>broken</tuv></tu>' + UNITS[0] + TAIL, HEAD.replace("en-US", "*all*") + UNITS[3] + TAIL)
    got = [(r.file, r.n, r.variants, r.fault is not None, r.source) for r in memories.units(rows, ["file"], "text").orderBy("file", "n").collect()]
    assert [g[:4] for g in got] == [(2, 1, 0, False), (2, 2, 0, False), (2, 3, 0, True), (2, 4, 3, False), (3, 1, 2, False)]
    assert got[4][4] == "Bonjour"
    (german,) = memories.units(rows.where("file = 3"), ["file"], "text", "de-AT").collect()
    assert (german.source, german.targets[0].text) == ("Hallo", "Bonjour")
    assert brought(imports.entries(spark), memories.units(rows, ["file"], "text"))[1] == {2: (2, 2, 1), 3: (1, 0, 0)}


def loop(held, rows):
    """Pair by pair."""
    state, out = {k: v for k, v in held.items()}, []
    for key, target in rows:
        old = state.get(key)
        if old and old[0] == target and old[1] in ("reviewed", "imported"):
            out.append("unchanged")
        elif old and old[1] == "reviewed":
            out.append("kept")
        else:
            out.append("updated" if old else "inserted")
            state[key] = (target, "imported")
    return out, state


@pytest.fixture(scope="module")
def many():
    """Pairs of which half have one key."""
    rng = random.Random(4)
    return [("hot" if rng.random() < 0.5 else f"s{rng.randint(0, 40)}", f"t{rng.randint(0, 2)}") for _ in range(900)]


HELD = {"s1": ("t1", "reviewed"), "s2": ("t0", "stale"), "s3": ("t2", "imported"), "never": ("t0", "stale")}


def memory_of(spark, held):
    form = {"reviewed": ("review", "approved"), "stale": ("review", "stale"), "imported": ("import", "imported")}
    rows = [("en", "de", "", None, s, t, *form[how], None) for s, (t, how) in held.items()]
    return imports.keyed(imports.entries(spark, rows)).select(imports.entries(spark).columns)


def unit(s, t):
    return f'<tu><tuv xml:lang="en"><seg>{s}</seg></tuv><tuv xml:lang="de"><seg>{t}</seg></tuv></tu>'


@pytest.mark.parametrize("least", [10, 100_000])
def test_against_a_loop(spark, many, monkeypatch, least):
    monkeypatch.setattr(prefix.previous, "__defaults__", (least,))
    texts = [HEAD + "".join(unit(s, t) for s, t in many[i : i + 50]) + TAIL for i in range(0, 900, 50)]
    rows = imports.pairs(memories.units(files(spark, *texts), ["file"], "text"), ["file"], ["file", "n"])
    done = imports.actions(memory_of(spark, HELD), rows, ["file", "n"]).orderBy("file", "n").collect()
    want, state = loop(HELD, many)
    assert [(r.source, r.action) for r in done] == [(s, a) for (s, _), a in zip(many, want, strict=True)]
    changes, _ = brought(memory_of(spark, HELD), memories.units(files(spark, *texts), ["file"], "text"))
    after = {r.source: r.target for r in imports.merged(memory_of(spark, HELD), changes).collect()}
    assert after == {s: t for s, (t, _) in state.items()}


def test_batches_with_a_stop(spark, many, tmp_path):
    """Three files a batch and a stop after half of them: entries and accounts are those of one import, and a batch that is
    written twice counts once."""
    store, inbox = str(tmp_path / "store"), tmp_path / "inbox"
    imports.create(memory_of(spark, HELD), store)
    inbox.mkdir()

    def arrive(first, last):
        for i in range(first, last):
            text = HEAD + "".join(unit(s, t) for s, t in many[i * 100 : i * 100 + 100]) + TAIL
            (inbox / f"{i}.json").write_text(json.dumps({"file": i, "text": text}))
            os.utime(inbox / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in order

    def run():
        read = spark.readStream.schema("file long, text string").option("maxFilesPerTrigger", 3).json(str(inbox))
        imports.import_stream(memories.units(read, ["file"], "text"), ["file"], ["file", "n"], "owner", store, str(tmp_path / "checkpoint")).awaitTermination()

    arrive(0, 5)
    run()
    arrive(5, 9)
    run()
    want, state = loop(HELD, many)
    assert {r.source: r.target for r in imports.current(spark, store).collect()} == {s: t for s, (t, _) in state.items()}
    told = spark.read.parquet(f"{store}/accounts")
    assert told.select("batch").distinct().count() >= 4
    by_file = [sum(a in ("inserted", "updated") for a in want[i : i + 100]) for i in range(0, 900, 100)]
    assert {r.file: r.imported for r in told.collect()} == dict(enumerate(by_file))
    run()  # nothing new arrived
    assert spark.read.parquet(f"{store}/accounts").count() == 9
