import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns that clash with results."""
    long = "alpha beta gamma delta " * 20_000
    rows = [
        (1, "The same words stand here for everyone to read in peace.", "en", "a", 1), (1, "The same words stand here for everyone to read in peace.", "en", "a", 1),
        (2, None, "en", "b", None), (3, "", None, None, 0), (None, "a row without an id but with some words", "de", "a", 5), (4, long, "fr", "a", 9),
        (5, " \n\t ", "fr", "b", 2), (6, "日本語 ’quoted’ — İstanbul ½", "de", None, 3), (7, "1234 5678", "en", "a", 4), (8, "idiot", "en", "a", 4),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for c in ("score", "size", "held_out", "start", "length", "offset", "sequence_id", "labels", "kept", "component_id", "taken", "copies", "host", "_id", "_row", "rep"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
