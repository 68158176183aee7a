import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed alone."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls, empty and long texts, repeated rows, a repeated text and an extra column that clashes."""
    long = prose(1, 3000)
    rows = [
        (1, "  Plain text, with words. And more! ", "x"), (2, None, "x"), (3, "", None), (4, " \t\n", "y"), (5, long, "z"),
        (6, long, "z"), (7, "é ▁ 😀 \x00 中文\r\nend", "x"), (7, "é ▁ 😀 \x00 中文\r\nend", "x"), (None, "no id here at all", "x"),
        (9, "no_spaces_" * 300, "x"), (10, "a", "x"), (11, prose(2, 400), "x"), (12, prose(2, 399) + " changed", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string").withColumnRenamed("score", "score")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, score string")


def write_tables(base, **tables):
    """One Parquet folder per table, as the queries read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    return str(base)
