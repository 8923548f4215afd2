import pytest
from pyspark.sql import Row

#: Cases that every operator must take: null and empty texts, repeated rows, long texts, odd white space, other columns.
TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h i j k l", "Ünïcode wörds çà et là — “quoted” nbsp", "tab\tline\nfeed\x0bvt\x0cff\rcr", "x" * 5000, "the quick brown fox " * 900, "the quick brown fox " * 900, "don't stop, it's 12,345 o'clock: <|startoftext|> ok!", "é combining İSTANBUL ΣΟΦΟΣ"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [Row(doc_id=k, text=t, lang="en", source="s", n_chars=len(t or ""), length=7, piece="clash", component=1, rep=2) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, piece string, component int, rep int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
