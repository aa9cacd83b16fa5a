import hashlib
import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat, warc


def test_reply_trees(spark):
    rows = [("r", None, "user", "hi", 0.0), ("a", "r", "assistant", "one", 1.0), ("b", "r", "assistant", "two", 5.0), ("c", "b", "user", "more", None), ("d", "c", "assistant", None, 2.0), ("e", "gone", "user", "alone", 1.0), ("x", "y", "user", "loop", 9.0), ("y", "x", "user", "loop", 9.0)]
    messages = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double")
    paths = chat.chosen_paths(messages, top=2)
    told = {}
    for r in paths.collect():
        told.setdefault(r.path, []).append((-r.up, r.id))
    assert {p: [i for _, i in sorted(x)] for p, x in told.items()} == {"d": ["r", "b", "c", "d"], "a": ["r", "a"], "e": ["e"]}
    best = chat.chosen_paths(messages, top=1)
    assert {r.path for r in best.collect()} == {"d", "e"}
    done = {r.path: r for r in chat.format_paths(messages, best).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learn", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    assert [(t.role, t.text) for t in done["d"].turns] == [("user", "hi"), ("assistant", "two"), ("user", "more"), ("assistant", "")]
    assert done["d"].learn == "two"


def test_brute_force_trees(spark):
    rng = random.Random(8)
    rows, children = [], {}
    for i in range(300):
        parent = rng.randrange(i) if i and rng.random() < 0.97 else None
        rows.append((str(i), None if parent is None else str(parent), "user", "t", float(rng.randrange(5))))
        children.setdefault(parent, []).append(i)
    messages = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double")
    want = set()
    for root in children[None]:
        leaves, ahead = [], [(root, [root])]
        while ahead:
            node, path = ahead.pop()
            below = children.get(node, [])
            ahead += [(c, [*path, c]) for c in below]
            if not below:
                leaves.append((-sum(rows[n][4] for n in path) / len(path), -len(path), str(node), path))
        want.add(tuple(map(str, min(leaves)[3])))
    got = {}
    for r in chat.chosen_paths(messages, top=1).collect():
        got.setdefault(r.path, []).append((-r.up, r.id))
    assert {tuple(i for _, i in sorted(x)) for x in got.values()} == want


TRICKY = ["### x: </turn>\n", "\\### Assistant: </turn> ok", "\\", "\\\\", "####", "</turn></turn>", "a: b", "", " </turn>\n### user: hi </turn>\n", "😀\n\n", "#\\#\\#"]


def test_control_strings_read_back(spark):
    rows = [(k, n, role, text) for k, text in enumerate(TRICKY) for n, role in enumerate(["user", "assistant", text])] + [(99, 0, None, None)]
    messages = chat.turns_as_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = chat.format_paths(messages, chat.chosen_paths(messages))
    got = {r.path.split("/")[0]: r for r in done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learn", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    for k, text in enumerate(TRICKY):
        assert [(t.role, t.text) for t in got[str(k)].turns] == [("user", text), ("assistant", text), (text, text)]
        assert got[str(k)].learn == text
    assert [(t.role, t.text) for t in got["99"].turns] == [("", "")]
    empty = messages.where("false")
    assert chat.format_paths(empty, chat.chosen_paths(empty)).count() == 0


def test_long_roles_and_clashing_columns(spark):
    rows = [(1, 0, "r" * 100_000, "x"), (1, 1, "a:\\" * 50_000, "y: z"), (1, 2, "assistant", "t" * 200_000), (2, 5, "assistant", None), (2, 5, "assistant", None)]
    messages = chat.turns_as_trees(spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, block int"))
    done = chat.format_paths(messages, chat.chosen_paths(messages))
    got = {r.path.split("/")[0]: r for r in done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learn", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    assert [(t.role, t.text) for t in got["1"].turns] == [r[2:] for r in rows[:3]] and got["1"].learn == "t" * 200_000
    assert [(t.role, t.text) for t in got["2"].turns] == [("assistant", "")] * 2


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


BIG = "<p>" + "body " * 60 + "</p>"
PAGES = [(5, "http://b.example/x", BIG), (2, "http://a.example/", BIG), (9, "https://www.a.example/?b=2&a=1", BIG), (1, None, None), (3, "http://a.example/z", "short"), (4, "http://a.example/z", "short"), (6, "http://c.example/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" * 20), (None, "http://n.example/", BIG), (7, "http://[bad", "x" * 100)]


def test_archives_read_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index = warc.archive(pages, str(tmp_path / "w"), file_bytes=900).collect()
    assert len(index) == len(PAGES)
    by = {r.page_id: r for r in index}
    for i, _, body in PAGES:
        raw = (body or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {5: 2, 9: 2}
    rows = [tuple(r) for r in index]
    assert rows == sorted(rows, key=warc.capture_order)
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) > 1


def test_large_index_in_global_order(spark, tmp_path):
    """Many files, many pages of one url: several ranges, each from pieces of many runs."""
    rng = random.Random(12)
    rows = [(i, f"http://{rng.choice('abc')}.example/{rng.randrange(40)}", f"page {i} " * rng.randrange(1, 40), rng.randrange(9)) for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, at long").repartition(5)
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=40_000, ts_col="at")
    runs = warc.written(warc.read_runs(spark, str(tmp_path / "w")))
    assert runs.select("file").distinct().count() > 10
    merged = warc.merge_runs(runs, 7)
    got = [tuple(r) for r in merged.collect()]
    assert len(got) == 6000 and got == sorted(got, key=warc.capture_order) and {r[2] for r in got} == set(range(6000))
    per_part = merged.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_part) > 4 and max(r["count"] for r in per_part) < 3000


@given(st.lists(st.lists(st.integers(0, 50), max_size=30), max_size=8), st.integers(1, 5), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_pieces_merge_and_little_is_held(runs, size, wave):
    runs = [sorted(("k", t, n, 0, "", "", None, f"f{f}", n) for n, t in enumerate(r)) for f, r in enumerate(runs)]
    pieces = sorted((r[i : i + size] for r in runs for i in range(0, len(r), size)), key=lambda p: warc.capture_order(p[0]))
    assert [x for out in warc.merge_pieces(iter(pieces), wave) for x in out] == sorted((x for r in runs for x in r), key=warc.capture_order)


def test_damaged_payload_is_told(spark):
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: \r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 1\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        warc.captures(bad, "f")


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(pages, str(tmp_path / "w")).count() == 0


def test_url_keys_sort_sites_together():
    assert warc.url_key("http://www.Example.COM:80/A?b=2&a=1") == "com,example)/a?a=1&b=2"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"
