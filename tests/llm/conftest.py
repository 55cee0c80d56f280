import pytest
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, LONG, "en", "b", len(LONG)),
        (5, LONG, "de", "b", len(LONG)),
        (6, "one two three", "en", None, 13),
        (6, "one two three", "en", None, 13),
        (7, "Der Hund läuft über die Straße.\nDer Hund läuft über die Straße!", "de", "c", 60),
        (None, "one two three four five six", "fr", "c", 27),
        (8, "123 456 !!! 789", "en", "c", 15),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(tmp_path):
    """A folder of Parquet tables, as queries read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def clashing(df):
    """df with columns named like those that operators add."""
    from pyspark.sql import functions as F

    for c in ("size", "target", "taken", "score", "languages", "kept", "line", "key", "first", "unit", "data", "open", "host", "path", "n_words", "row", "all", "others", "id", "gone", "stays", "of", "part", "range", "h", "_w", "_h", "_s", "_p", "_id", "_kept", "_suffix", "unit", "odd.name"):
        df = df.withColumn(c, F.lit("x"))
    return df
