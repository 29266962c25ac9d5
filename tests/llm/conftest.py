import pytest
from pyspark.sql import Row


@pytest.fixture()
def documents(spark):
    """A maker of documents with awkward rows, and a column that is not asked for."""

    def make(texts, sources=None, ids=None):
        rows = [Row(doc_id=ids[i] if ids else i, text=t, lang=None, source=sources[i] if sources else f"s{i % 3}", n_chars=None, slot="x", size="y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, size string")

    return make


AWKWARD = [None, "", " ", "\n\n  \t", "one", "One two  three\n four", "x" * 30_000, "word " * 20_000, "same text here", "same text here", "a b  c é 漢字 🙂", "'s <|endoftext|> \0 end  "]
