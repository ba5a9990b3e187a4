import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwéß") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    shared = prose(2, 30)
    rows = [
        (0, base, "en", "a", len(base)), (1, " ".join(near), "en", "a", 1), (2, base, "en", "b", None), (2, base, "en", "b", None),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, "  \n\t ", "de", "a", 5), (6, "one two", "en", "a", 7), (7, "ONE two", "en", "a", 7),
        (8, prose(3, 60) + " " + shared + " " + prose(4, 60), "en", "a", 9), (9, prose(5, 40) + " " + shared + ". " + prose(6, 90), "fr", "a", 9),
        (10, "a" * 5000, "en", "a", 5000), (11, "b" + "a" * 3000 + "c", "en", "a", 3002), (12, prose(7, 8000), "en", "c", None),
        (13, "日本語テキスト " * 40, "ja", "c", 320), (14, "x\x00y \x1c z' s", "en", "c", 9), (15, prose(7, 8000) + " more", "en", "c", 1),
        (None, base, "en", "a", 3), (None, None, "en", "a", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
