import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOC)

    return make


ODD = [(1, None), (2, ""), (None, "no id"), (3, " \t\n\r "), (4, "word " * 5000), (5, "same text"), (5, "same text"), (6, "x" * 3000), (7, "naïve ½² 日本語 <|endoftext|> it's")]


@pytest.fixture()
def odd(docs):
    return docs(ODD)
