import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with the columns of the table; ids count from 0."""

    def make(texts, ids=None):
        rows = rows_of(texts)
        if ids is not None:
            rows = [(i, *r[1:]) for i, r in zip(ids, rows, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Texts that every operator must bear: null, empty, blank, one word, other scripts, a very long one, repeats."""
    rng = random.Random(7)
    words = [rng.choice(["alpha", "Beta", "gamma,", "DELTA", "épée", "日本語", "x"]) for _ in range(30_000)]
    long = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    return [None, "", "  \n\t \n", "word", "Ünïcödé 日本語 😀 ▁mark \u0000nul \x1f", long, "same text here now\nand more of it\nthird line", "same text here now\nand more of it\nthird line", "A" * 5000, "\n\n\na\n\nb\n"]
