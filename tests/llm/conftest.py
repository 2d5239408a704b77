import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    base = say(60)
    rows = [(i, say(rnd.randint(1, 80)), "en", f"s{i % 3}", 1, 0.5, 7) for i in range(40)]
    rows += [(50, base, None, "s0", None, None, None), (51, base + " x", "en", None, 1, 0.1, 1), (52, base, "en", "s1", 1, 0.1, 1)]
    rows += [(60, None, "en", "s0", 0, None, None), (61, "", None, "s0", 0, None, None), (62, " \t\n ", "en", "s2", 3, None, None), (None, "only words", "en", "s1", 1, None, None)]
    rows += [(70, say(30_000) + " É " + "y" * 300_000, "en", "s2", 1, None, None), (50, base, None, "s0", None, None, None), (80, "It's <|endoftext|> ÀÉ 12,5 日本 \U0001f600 end", "en", "s1", 1, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
