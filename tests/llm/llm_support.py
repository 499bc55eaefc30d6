from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def docs(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows."""
    words = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog again and again until dusk falls on the hill far away today", "en", "s", 1),
        (1, "the quick brown fox jumps over the lazy dog again and again until dusk falls on the hill far away today", "en", "s", 1),
        (1, "the quick brown fox jumps over the lazy dog again and again until dusk falls on the hill far away today", "en", "s", 1),
        (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id here", "en", "s", 1), (None, None, None, None, None),
        (4, " \t\n ", "en", "s", 4), (5, "one", "en", "s", 3), (6, words, "en", "s", len(words)),
        (7, "A　b é\U0001F600 <|endoftext|> x\x00y", "en", "s", 9), (8, "a  b   c\n\n d", "en", "s", 9),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOC)



def clash(df, *names):
    """``df`` with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("x").alias(n) for n in names])


