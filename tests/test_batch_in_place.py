from __future__ import annotations

import os

from textloom.functions import text as T
from textloom.operators.postings import PostingStore


def test_texts_of_a_batch_and_terms_of_replaced_documents_are_not_stored(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = PostingStore(spark, f"file://{tmp_path}/i", T.tokens_en)
    store.apply(frame([(1, "a b"), (2, "b c"), (2, "b c"), (None, "z")]), 0)
    for _ in range(2):  # as a stream replays it
        store.apply(frame([(2, "c c d"), (3, "e")]), 1)
    assert not os.path.exists(f"{tmp_path}/i/v=0/batch")
    assert spark.read.parquet(f"file://{tmp_path}/i/v=1/replaced").columns == ["id", "old", "dl"]
    assert {r["term"]: r["df"] for r in store.lexical().terms.collect()} == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1}
    assert sorted((r["id"], r["version"]) for r in store.live().collect()) == [(1, 0), (2, 1), (3, 1)]
