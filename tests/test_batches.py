"""UDFs over slices: no slice is larger than said, whatever the batch, and results stay in their places."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions.batches import each_row, sliced


@pytest.mark.parametrize("rows", [0, 1, 7, 1000])
def test_slices(spark, rows):
    @sliced(t.ArrayType(t.StructType().add("n", "integer").add("x", "long")), 7)
    def told(a: list, b: list) -> list:
        return [[{"n": len(a), "x": None if x is None else x + y}] for x, y in zip(a, b, strict=True)]

    df = spark.range(0, rows, 1, 1).withColumn("a", F.when(F.col("id") % 5 > 0, F.col("id")))
    got = df.select("id", "a", told("a", "id").alias("t")).select("id", "a", F.col("t")[0].alias("t")).collect()
    assert len(got) == rows and all(r.t.n <= 7 and r.t.x == (None if r.a is None else 2 * r.id) for r in got)


def test_rows_of_texts(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(9)], "k int, body string")
    got = each_row(df, ["k"], "body", "n int, x string", lambda s: ((i, s) for i in range(1000 * len(s or ""))))
    assert got.columns == ["k", "n", "x"] and {(r["k"], r["count"]) for r in got.groupBy("k").count().collect()} == {(i, 1000 * i) for i in range(9) if i not in (0, 3)}
    assert got.where("x != repeat('x', k)").count() == 0


@pytest.mark.parametrize("name", ["glossary.tokens", "alignment._align", "language.word_diff", "structured._told"])
def test_long_results_go_by_slices(name):
    """A batch of 10,000 rows as Python objects took up to a gigabyte in each worker; these take slices of Arrow batches."""
    from weftline.functions import language
    from weftline.operators import alignment, glossary
    from weftline.sources import structured

    made = {"glossary.tokens": glossary.tokens, "alignment._align": alignment._align, "language.word_diff": language.word_diff, "structured._told": structured._told("yaml")}[name]
    assert made.func.__module__ == "weftline.functions.batches"
