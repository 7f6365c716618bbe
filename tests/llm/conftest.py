import pytest

from ..conftest import DATA

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, root long, score double, doc long, item string, owner string, __fp string"
LONG = " ".join(f"word{i * i % 977}" for i in range(8_000))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with the names of inner ones."""
    tail = (1, 2, 0.5, 3, "x", "y", "z")
    texts = [None, "", "   ", "one", "One  two\tthree", LONG, LONG + " end", "1234 !!! --", "déjà vu — naïve 日本語 😀 text here", "token = abcdefghij0123456789"]
    values = [(i, t, "en" if i % 2 else None, "src", 1, *tail) for i, t in enumerate(texts)]
    values += [values[3], values[3], (None, "one", None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
    return spark.createDataFrame(values, ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
