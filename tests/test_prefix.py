"""Prefix scans where one key holds most rows: the same rows as a window, in many ranges of like size."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import prefix
from weftline.operators import relational as ops


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    start = datetime.datetime(2026, 1, 1)
    made = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), start + datetime.timedelta(minutes=rng.randint(0, 9000)), rng.choice([None, 1, 2, -3, 10])) for i in range(6000)]
    return made + [(10_000 + i, "tied", start, 1) for i in range(900)] + [(20_000 + i, "hot", None, 1) for i in range(5)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, at timestamp, v int")


def test_ranges_of_a_hot_key_are_even(spark, rows):
    cut = prefix.spread(frame(spark, rows), ["k"], "at", least=100).select("k", "at", "_range").collect()
    sizes = Counter((r.k, r._range) for r in cut)
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) >= 30 and max(hot) <= 3 * sum(hot) / len(hot)
    assert len({r for (k, r) in sizes if k == "tied"}) == 1
    by_range = {}
    for r in cut:
        if r.k == "hot" and r.at:
            by_range.setdefault(r._range, []).append(r.at)
    spans = [(min(x), max(x)) for _, x in sorted(by_range.items())]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_running_sums(spark, rows):
    for least in (50, 100_000):
        got = {r.id: r.s for r in prefix.running_sum(frame(spark, rows), ["k"], ["at", "id"], "v", "s", least).collect()}
        want, totals = {}, {}
        for i, k, _, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            totals[k] = v if totals.get(k) is None else totals[k] + (v or 0)
            want[i] = totals[k]
        assert got == want


def test_as_of(spark, rows):
    versions = [r for r in rows if r[0] % 40 == 0 and r[2]]
    asked = [r[:3] for r in rows if r[0] % 40 and r[2]]
    v = frame(spark, versions).select("k", "at", F.col("id").alias("version"))
    q = frame(spark, [(*r, None) for r in asked]).drop("v")
    for least in (50, 100_000):
        got = {r.id: r.version for r in prefix.as_of(q, v, ["k"], "at", ["version"], least).collect()}
        want = {}
        for i, k, at in asked:
            before = [(w[2], w[0]) for w in versions if w[1] == k and w[2] <= at]
            if before:
                want[i] = max(before)[1]
        assert got == want


def test_no_task_has_a_hot_key_alone(spark, rows):
    """The window's exchange deals the hot key's ranges out over the partitions."""
    spread = prefix.spread(frame(spark, rows), ["k"], "at", least=50).where("k = 'hot'")
    dealt = spread.repartition(16, "k", "_range").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 0.25 * sum(r["count"] for r in dealt)


def test_fifo_with_a_hot_key(spark):
    lots = spark.createDataFrame([("h", i, 10) for i in range(500)] + [("c", 0, 5)], "k string, n int, amount int")
    need = spark.createDataFrame([("h", 2504), ("c", 9)], "k string, needed int")
    got = ops.fifo_draws(lots, need, ["k"], ["n"], least=20).collect()
    assert {(r.k, r.n): r.take for r in got} == {("h", i): 10 if i < 250 else 4 if i == 250 else 0 for i in range(500)} | {("c", 0): 5}


def test_orders_that_cannot_be_cut(spark, rows):
    with pytest.raises(ValueError, match="no number"):
        prefix.spread(frame(spark, rows).withColumn("at", F.col("at").cast("string")), ["k"], "at", least=50)
