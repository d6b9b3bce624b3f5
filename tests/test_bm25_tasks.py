from __future__ import annotations

import random

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lexical as L


def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)]
    texts += [texts[7]] * 120 + [None, "", "w1 w1 w1"]  # many equal scores
    docs = spark.createDataFrame([(i * 37 % 1009, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words + ["none"], k=5))) for i in range(9)] + [("like", texts[7])], "query_id string, text string")
    return docs, asked


def test_tasks_keep_what_the_join_ranks_first_and_shuffle_no_posting(spark, monkeypatch):
    docs, asked = corpus(spark)
    tokens = T.tokens_en(F.col("text"))
    index = L.build_stored(docs, tokens)
    monkeypatch.setattr(L, "_CELLS", 300)
    terms = L.asked_terms(asked, tokens).select("query_id", "term", F.col("qtf").alias("w"))
    for k in (1, 4, 15):
        parts = L.candidates(index.docs, terms, k, lambda tf, dl: L.impact(tf, dl, 15.0))
        assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
        tasks = L.top(parts, k).select("query_id", "id", F.round("score", 6), "rank").collect()
        with monkeypatch.context() as m:
            m.setattr(L, "ASKED", 3)
            joined = L.top(L.candidates(index.docs, terms, k, lambda tf, dl: L.impact(tf, dl, 15.0)), k).select("query_id", "id", F.round("score", 6), "rank").collect()
        assert sorted(tasks) == sorted(joined) and len(tasks) == 10 * k


def test_padding_knows_matches_that_are_not_among_the_best(spark):
    # the second list of zeros must not hold a document whose own score is below zero
    docs = spark.createDataFrame([(i, "a b" if i < 9 else "a c") for i in range(10)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "zzz")], "query_id long, text string")
    got = L.search(L.build_stored(docs, T.tokens_en(F.col("text"))), asked, T.tokens_en(F.col("text")), 3).collect()
    by = {q: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2)}
    assert by == {1: [0, 1, 2], 2: [0, 1, 2]} and all(r["score"] != 0 for r in got if r["query_id"] == 1)
