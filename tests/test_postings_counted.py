from __future__ import annotations

import os

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.postings import PostingStore


def test_a_version_counts_terms_in_place(spark, tmp_path):
    rows = [(1, "b a a"), (2, ""), (3, None), (4, "c b")]
    store = PostingStore(spark, f"file://{tmp_path}/i", T.tokens_en)
    store.apply(spark.createDataFrame(rows, "doc_id long, text string"), 0)
    assert not os.path.exists(f"{tmp_path}/i/v=0/postings")  # postings were dealt by document and written before
    docs = {r["id"]: (r["dl"], {x["term"]: x["tf"] for x in r["terms"]}) for r in store.live().collect()}
    assert docs == {1: (3, {"a": 2, "b": 1}), 2: (0, {}), 3: (docs[3][0], {}), 4: (2, {"b": 1, "c": 1})}
    assert {r["term"]: r["df"] for r in store.lexical().terms.select("term", F.col("df").cast("int").alias("df")).collect()} == {"a": 1, "b": 2, "c": 1}
