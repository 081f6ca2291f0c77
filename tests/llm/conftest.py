import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, repeated rows, white space, other scripts, and one long text."""
    base = prose(1, 120)
    return [
        (1, base, "en", "a", None), (
            2,
            base.replace(" ", "\n"),
            "en",
            "a",
            None,
        ), (3, base + "  ", None, None, None), (3, base + "  ", None, None, None),
        (4, None, None, None, None), (5, "", "en", "b", None), (6, " \n\t", "en", "b", None), (None, "lonely text", "en", "b", None),
        (
            7,
            "\U0001f600 строка 中文 " * 30,
            "ru",
            "c",
            None,
        ), (8, prose(2, 6000), "en", "a", None), (9, "one", "en", "c", None), (10, prose(3, 50), "en", "a", None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, DOCUMENTS).withColumns(
        {c: F.lit("x") for c in ("key", "node", "_row", "shard", "spans", "slot", "band", "base", "v", "score_")}
    )


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
