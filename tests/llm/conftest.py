import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word other more " * 30_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with the operators' own names."""
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (4, LONG, "s"), (5, "a b c", "t"), (5, "a b c", "t"),
            (6, "a b c", None), (None, "x y z", "t"), (None, None, None), (7, "A B C", ""), (8, "ü ß </s> cc by", "t")]
    made = [(i, t, None, s, len(t or ""), -1, -1, "x", -1.0, -1, -1, -1) for i, t, s in rows]
    names = ("size long, shard long, kept string, score double, _words long, copies long, n_words long")
    return spark.createDataFrame(made, f"{DOCS}, {names}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
