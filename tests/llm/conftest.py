import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, kinds=400):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) + str(rng.randrange(kinds)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    rows = [
        (1, "plain text of a few words, nothing else", "en", "a", 10),
        (1, "plain text of a few words, nothing else", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, " \t\n\x0b", "fr", None, 4),
        (None, "text without an identifier", "en", "b", 5),
        (None, "text without an identifier", "en", "b", 5),
        (5, long, "en", None, len(long)),
        (6, long + " tail", "en", "c", len(long)),
        (7, "é😀 ñ ß", None, None, 7),
        (7, "another text under the same identifier", "de", "c", 3),
        (-8, "x" * 300_000, "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = ["score", "size", "key", "row", "component", "node", "target", "copies", "block", "_own", "_hash", "_again", "_doc"]
    return odd_docs.select("*", *(F.lit(f"{n}!").alias(n) for n in names)).cache()


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


@pytest.fixture
def sf(tmp_path, spark):
    """A folder with the given tables."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
