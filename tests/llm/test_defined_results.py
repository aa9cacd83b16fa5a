"""Cases that once crashed, or had no defined result."""

import random

import numpy as np
import pytest

from weftline.llm import chat, interpolation, licenses, pieces, quality, warc
from weftline.llm.queries import PIECE_MODEL


@pytest.mark.parametrize(("work", "name"), [(licenses.scan_licenses, "score"), (quality.score_quality, "Kept"), (interpolation.score, "score"), (interpolation.score, "N_Tokens")])
def test_ids_with_the_name_of_a_result(frame, work, name):
    with pytest.raises(ValueError, match="result column"):
        work(frame(["a text"]).withColumnRenamed("doc_id", name), name)


@pytest.mark.parametrize("work", [licenses.scan_licenses, quality.score_quality, interpolation.score])
def test_clashing_columns_ties_and_empty_tables(frame, work):
    df = frame(["same text"] * 3, [1, 1, None]).selectExpr("doc_id", "text", "1 as score", "2 as kept", "3 as id", "4 as labels")
    rows = [tuple(r)[1:] for r in work(df).collect()]
    assert len(rows) == 3 and all(str(r[1:]) == str(rows[0][1:]) for r in rows)
    assert work(df.limit(0)).collect() == []


def test_times_out_of_reach_are_clamped(spark, tmp_path):
    times = [-(10**15), -62135596801, -62135596800, 0, 253402300799, 253402300800, 10**15, None]
    rows = [(i, f"http://h.example/{i}", "payload " * 30, t) for i, t in enumerate(times)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, ts long")
    warc.write_archives(pages, str(tmp_path / "a"), ts_col="ts")
    got = {r.page_id: r.ts for r in warc.merge_runs(warc.read_runs(spark, str(tmp_path / "a"))).collect()}
    assert got == {i: max(-62135596800, min(253402300799, t or 0)) for i, t in enumerate(times)}


def test_files_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://h/", "日本" * 100 + str(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "b"), file_bytes=3000)
    import glob
    import gzip

    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{tmp_path}/b/*.gz")]
    assert len(sizes) > 10 and max(sizes) <= 3000


def test_the_null_conversation_and_one_called_null(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), ("null", 0, "user", "c"), ("null", 1, "assistant", "d"), ("x/1", 0, "user", "e"), ("", 0, "user", "f"), ("\\null", 0, "user", "g")]
    messages = chat.turns_as_trees(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    done = chat.format_paths(messages, chat.chosen_paths(messages)).select(chat.conversation(chat.F.col("path")).alias("c"), chat.read_back(chat.F.col("formatted")).alias("t"))
    assert {r.c: [x.text for x in r.t] for r in done.collect()} == {None: ["a", "b"], "null": ["c", "d"], "x/1": ["e"], "": ["f"], "\\null": ["g"]}


def test_messages_that_stand_twice(spark):
    rows = [("r", None, "user", "hi", 1.0), ("r", None, "user", "ho", 1.0), ("c", "r", "assistant", "yes", 1.0), ("c", "r", "assistant", "yes", 1.0)]
    messages = chat.once(spark.createDataFrame(rows, "id string, parent string, role string, text string, score double"))
    (done,) = chat.format_paths(messages, chat.chosen_paths(messages)).collect()
    assert done.formatted == "### user: hi </turn>\n### assistant: yes </turn>\n"


def test_long_texts_are_cut_between_chunks(monkeypatch):
    """Whatever the size of a group, the draws of a text are the same, and its ids give it back."""
    from pathlib import Path

    sampler = pieces.Sampler(pieces._loaded(Path(PIECE_MODEL).read_bytes(), 1.0))
    rng = random.Random(1)
    words = ["word", "segmentation", "ünï", "日本語", "▁mark", "x▁", "", "  ", "\n", "😀", "12345"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 5, 300, 4000)] + ["", "▁", "▁▁x"]
    keys = list(range(len(texts)))
    whole = sampler.encode(keys, texts)
    for group in (1, 7, 1000):
        monkeypatch.setattr(pieces, "GROUP", group)
        assert all(np.array_equal(a, b) for a, b in zip(whole, sampler.encode(keys, texts), strict=True))
    assert [sampler.decode(x) for x in whole] == texts


def test_memory_of_a_long_text_stays_with_the_group():
    """Thirty million characters: what is held beside the ids doesn't grow with them."""
    import tracemalloc
    from pathlib import Path

    sampler = pieces.Sampler(pieces._loaded(Path(PIECE_MODEL).read_bytes(), 1.0))
    peak = []
    for n in (200_000, 1_000_000):
        text = "lorem ipsum dolor sit amet " * (n // 27)
        tracemalloc.start()
        sampler.encode([1], [text])
        peak.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peak[1] < peak[0] + 40
