import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark):
    """docs(rows): rows are (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = []
        for r in rows:
            i, text, lang, source = (*r, None, None)[:4]
            full.append((i, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)

    return make
