"""Trigram matches in scripts other than ASCII."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import review


@pytest.mark.parametrize(
    ("entry", "asked"),
    [
        ("Уговор истиче 31. марта.", "Уговор истиче 30. марта."),
        ("Η σύμβαση λήγει στις 31 Μαρτίου.", "Η σύμβαση λήγει στις 30 Μαρτίου."),
        ("ينتهي العقد في مارس المقبل.", "ينتهي العقد في مارس القادم."),
        ("合同将于三月底到期。", "合同将于四月底到期。"),
        ("Äöü ß éèê ñ", "äöü ß éèê ñó"),
    ],
)
def test_near_matches(spark, entry, asked):
    e = spark.createDataFrame([(1, entry), (2, "Penguins live in Antarctica.")], "id int, source string")
    q = spark.createDataFrame([("q", asked)], "query string, source string")
    assert [r.id for r in review.fuzzy_matches(q, e, least=60.0).collect()] == [1]


def test_accented_words_are_whole(spark):
    got = spark.range(1).select(T.trigrams(F.lit("Élan ÜBER")).alias("g")).first().g
    assert sorted(got) == sorted(["  é", " él", "éla", "lan", "an ", "  ü", " üb", "übe", "ber", "er "])
