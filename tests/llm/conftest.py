import hashlib

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and white texts, repeats, and columns whose names clash with what operators add."""
    long = " ".join(hashlib.md5(str(k).encode()).hexdigest()[: k % 9 + 1] for k in range(30_000))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (4, "one"), (None, "one two"), (5, long), (6, long + " x")]
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("n_words", T.LongType()), ("kept", T.StringType()), ("key", T.StringType()), ("size", T.LongType()), ("spans", T.StringType()), ("toxic", T.IntegerType()), ("use", T.IntegerType()))])
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", len(t or ""), 7, "k", "q", 1, "z", 1, 0) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
