import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, fp string, start int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", "a", 3),
        (5, "the same words stand here twice over", "en", "a", 9), (6, "the same words stand here twice over", "en", "b", 9),
        (6, "the same words stand here twice over", "en", "b", 9), (None, "a text without an id", "en", "b", 9),
        (None, "a text without an id", "en", "b", 9), (None, None, None, None, None),
        (7, "long words repeat " * 20000, "en", "b", 360000), (8, "ünïcödé 😀 \x00 ﬀ", "de", "c", 12), (9, "x" * 50000, "de", "c", 50000),
    ]
    return spark.createDataFrame([(*r, "k", "f", 0) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
