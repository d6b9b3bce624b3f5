from __future__ import annotations

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

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    def make(texts, langs=None, sources=None):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """The rows of the smallest documents table, as dicts."""
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
