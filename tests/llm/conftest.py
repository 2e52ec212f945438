import pytest

#: Null, empty, blank and very long texts, ties, repeated rows, null ids, and columns named like results.
ODD = [
    (3, "one two three four five six", "en", "a"), (3, "one two three four five six", "en", "a"), (1, "one  two\tthree four five six", None, None),
    (None, "one two three four five six", "en", "b"), (None, None, "de", "b"), (7, None, None, ""), (8, "", "en", "a"), (9, " \n\t ", "en", "a"),
    (10, "word " * 30000, "en", "a"), (11, "x" * 70000, "en", "a"), (12, "中文 テスト é ñ 😀 " * 20, "fr", "c"), (13, "12345 !!! 678", "es", "c"),
    (13, "other text under one id", "es", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = ["id", "mark", "to", "kind", "key", "part", "line", "digest", "score", "root", "slot", "_id", "count", "n", "h1", "w0", "_lang", "_position", "_key", "_digest"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
