import pytest

from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"shared{k}" for k in range(60))

#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, special strings.
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, None), (None, "no id at all, twice", "en", "a", 18),
    (None, "no id at all, twice", "en", "a", 18), (4, "The same text here.", "en", "a", 19), (5, "The same  text\there.", "en", "b", 20),
    (6, "Thesametexthere.", "en", "b", 16), (7, "The same  text\nhere.", "en", "b", 20), (8, "repeated row with a text", "en", "c", 24),
    (8, "repeated row with a text", "en", "c", 24), (9, "<|endoftext|> is a string here <s> </s>", "en", "c", 39), (10, "word " * 60_000, "en", "hot", 300_000),
    (11, "\U0001f600 éÉ İstanbul", "tr", "hot", 12), (12, f"left side {PASSAGE} right", "en", "hot", 1), (13, f"another start {PASSAGE} and end", "en", "hot", 1),
    (14, "x", "en", "hot", 1), (15, "x" * 50_000, "en", "hot", 50_000),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    clashes = ["row", "digest", "n_points", "fp", "cell", "key", "label", "score", "hot_id", "hot_size", "_digest", "a", "b", "root", "component_id", "start", "words"]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashes)])


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")
