import pytest

#: doc_id, text, lang, source, n_chars and columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, rid string, sha string, fp string, n string, score string, rate double, cdf string, term string, node string, bucket string"
LONG = "Der lange Text geht weiter und weiter. " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty and very long texts, ties and repeats, and further columns with clashing names."""
    more = ("x",) * 6 + (0.5,) + ("y",) * 4
    rows = [
        (1, "The cat sat on the mat and looked at the moon.", "en", "a", 46, *more),
        (1, "The cat sat on the mat and looked at the moon.", "en", "a", 46, *more),
        (2, "The cat sat on the mat and looked at the moon.", "en", "b", 46, *more),
        (3, None, None, None, None, *[None] * 11),
        (4, "", "en", "a", 0, *more),
        (5, LONG, "de", "a", len(LONG), *more),
        (6, LONG, "de", None, len(LONG), *more),
        (None, "nobody knows this row", None, "a", 21, *more),
        (None, "nobody knows this row", None, "a", 21, *more),
        (7, "12345 !!! ---", "en", "c", 13, *more),
        (8, "\U0001f600 émoji ünïcode \U0001f680", "fr", "c", 17, *more),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
