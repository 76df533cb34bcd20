import pytest

#: Texts that every operator has to take: null, empty, white space, one word, very long, other scripts, repeated.
ODD = [None, "", " \n\t ", "word", "x" * 50_000, "a b " * 20_000, "日本語 текст ελληνικά İstanbul ﬁ ́", "same text here", "same text here", "\x00\x1c\x1f\x85  z", "<|endoftext|> <|startoftext|>", "é" * 300]


@pytest.fixture
def docs(spark):
    """Makes documents of texts, with ids from 0, columns whose names clash with the operators' own, and repeated rows."""

    def make(texts, ids=None, langs=None, sources=None):
        rows = [(i, t, lang, s, 1, 2, "k", 3.0) for i, t, lang, s in zip(ids or range(len(texts)), texts, langs or [None] * len(texts), sources or [None] * len(texts), strict=True)]
        schema = "doc_id long, text string, lang string, source string, size long, unit long, key string, rank double"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def odd(docs):
    return docs([*ODD, "same text here"], ids=[*range(len(ODD)), 7])


@pytest.fixture
def nothing(docs):
    return docs([])
