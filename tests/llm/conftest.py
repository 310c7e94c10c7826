import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, ids string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    long = " ".join(f"word{i % 977} thing{i % 613}" for i in range(12_000))
    texts = [None, "", "A", "a", "same Text here", "same text here", "same text here", long, long + " end", "x" * 5000, " \n\t ", "été Straße 日本語 🙂"]
    rows = [(i, t, "en", None, None, "k", 0.5, "c") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
