import pytest

#: Nulls in any column, empty and blank texts, repeated rows, and extra columns with names that operators use inside.
EDGE = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, runs string, key long, marks string, path string, term string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "  \t\n "), (None, "x y z"), (None, None), (5, "wörld " * 400), (6, "wörld " * 400), (7, "日本語 テキスト 🙂"), (8, "one\x00two  three   four")]
    return spark.createDataFrame([(i, t, None, None, None, None, 7, "r", 1, "m", "p", "t") for i, t in rows], EDGE)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE)
