import pytest

from pyspark.sql import types as T

LONG = " ".join(f"wort{i % 977} and{i % 31}" for i in range(30_000))  # one very long text
NAMES = ("doc_id", "text", "lang", "source", "n_chars")
#: Further columns named like columns the operators use themselves.
CLASHING = ("size", "h", "fp", "root", "d", "score", "features", "n_words", "variant", "src", "id")

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (3, "", "en", "a"),
    (4, None, None, None),
    (5, " \n\t ", "fr", None),
    (6, LONG, "de", "a"),
    (7, "Le renard brun saute par dessus le chien et la riviere\nLe renard brun\nLe renard brun", "fr", "c"),
    (7, "Le renard brun saute par dessus le chien et la riviere\nLe renard brun\nLe renard brun", "fr", "c"),
    (None, "a row without an id but with words", "en", "a"),
    (None, "a row without an id but with words", "en", "a"),
    (8, "### ### $$$ %%% words", "es", "é"),
    (9, "12 34 !!", "en", "B"),
]


def frame(spark, rows=ROWS):
    kinds = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
             T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
             T.StructField("n_chars", T.LongType())]
    kinds += [T.StructField(c, T.StringType()) for c in CLASHING]
    data = [(i, t, la, s, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, la, s in rows]
    return spark.createDataFrame(data, T.StructType(kinds))


@pytest.fixture(scope="module", autouse=True)
def _nothing_left_cached(spark):
    """The session is shared: what a module's tests have cached is dropped after it."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    return frame(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
