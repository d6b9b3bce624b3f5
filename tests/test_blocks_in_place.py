from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lexical as L
from textloom.operators import postings as P


def texts(n: int, words: int) -> list[tuple[int, str]]:
    rng = random.Random(9)
    return [(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(words))) for i in range(n)]


def test_blocks_are_cut_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 2000)
    docs = spark.createDataFrame([*texts(900, 60), (7, "again"), (1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    counted = L.counted(docs, T.tokens_en(F.col("text")))
    blocks = P.to_blocks(counted.filter("id <> 7")).collect()
    assert "Exchange" not in P.to_blocks(L.counted(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), T.tokens_en(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    want = {(r["id"], x["term"], x["tf"], r["dl"]) for r in counted.filter("id <> 7").collect() for x in r["terms"]}
    got = [(h["id"], b["term"], h["tf"], h["dl"]) for b in blocks for h in b["held"]]
    assert set(got) == want and len(got) == len(want)
    assert len({b["cut"] for b in blocks}) == len(blocks) and max(b["n"] for b in blocks) <= P.BLOCK
    assert all(b["n"] == len(b["held"]) and b["most_tf"] == max(h["tf"] for h in b["held"]) and b["least_dl"] == min(h["dl"] for h in b["held"]) for b in blocks)


@pytest.mark.parametrize("listed", [1 << 21, 3])
def test_search_reads_documents_where_they_are(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(P, "CHUNK", 3000)
    monkeypatch.setattr(P, "BLOCK", 20)
    monkeypatch.setattr(P, "LISTED", listed)
    docs = spark.createDataFrame(texts(600, 40), "doc_id long, text string")
    questions = spark.createDataFrame([(i, t) for i, t in texts(8, 25)], "query_id long, text string")
    store = P.PostingStore(spark, str(tmp_path / "i"), T.tokens_en)
    store.apply(docs.filter("doc_id < 400"), 0)
    store.apply(docs.filter("doc_id >= 300"), 1)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "rank", F.round("score", 6)).collect())
    assert rows(store.search(questions, T.tokens_en(F.col("text")), 5)) == rows(L.search(L.build(docs, T.tokens_en(F.col("text"))), questions, T.tokens_en(F.col("text")), 5, pad=False))
