import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) pairs or full rows; extra columns with names operators use."""
    def make(rows, extra=False):
        full = [r if len(r) == 5 else (*r, "en", "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS node", "2 AS key", "'x' AS rank", "3 AS salt", "4 AS length", "5 AS shard") if extra else df
    return make


#: nulls, empty and blank texts, a long text, repeated rows, ties
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "ab " * 40000), (6, "same text here now"),
        (6, "same text here now"), (7, "same text here now"), (None, "no id at all"), (8, "Ünïcödé  two  spaces\nline")]


@pytest.fixture()
def edge_docs(make_docs):
    return make_docs(EDGE, extra=True)


@pytest.fixture()
def empty_docs(make_docs):
    return make_docs([])
