import pytest

from pyspark.sql import functions as F

LONG = "und so weiter " * 9000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog"),
        (2, "The cat  sat\ton the mat and looked at the dog"),
        (3, None),
        (4, ""),
        (5, " \n"),
        (6, LONG),
        (7, LONG),
        (7, LONG),
        (None, "no id here at all"),
        (8, None),
        (9, "12 34 !?"),
        (10, "one two"),
        (10, "three four five six"),
    ]
    df = spark.createDataFrame([(i, t, "en" if t else None, 7, "x", [1], 0.5) for i, t in rows], "doc_id long, text string, lang string, id int, norm string, hits array<int>, score double")
    return df.withColumns({"name": F.lit(1), "bucket": F.lit("b"), "sketch": F.lit(0), "owner": F.lit(None).cast("string"), "level": F.lit(2)})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
