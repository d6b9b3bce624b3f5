from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import entities as G
from textloom.operators import lexical as L
from textloom.operators import postings as P

SCHEMA = "doc_id long, text string, gone boolean"


def tokens(column):
    return T.tokens_en(column)


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def same_index(got, docs):
    want = L.build(docs, tokens(F.col("text")))
    assert rows(got.postings.select("term", "id", "tf", "dl")) == rows(want.postings.select("term", "id", "tf", "dl"))
    assert rows(got.lengths.select("id", "dl")) == rows(want.lengths) and rows(got.terms) == rows(want.terms) and rows(got.stats) == rows(want.stats)


@pytest.fixture
def texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.randint(0, 60))), False) for i in range(150)]


def test_batches_leave_the_index_of_all_at_once(spark, tmp_path, texts):
    extras = {"mentions": lambda df: df.select("id", F.explode(G.acronyms(F.upper("text"))).alias("entity"))}
    store = P.PostingStore(spark, str(tmp_path / "index"), tokens, extras=extras)
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    latest = {}
    batches = [texts[:80], texts[60:150], [(i, f"new text {i}", False) for i in range(0, 30, 3)], [(5, None, True), (7, "", False), (8, None, False), (999, "late", False)], []]
    for version, batch in enumerate(batches):
        for _ in range(2):  # a replay changes nothing
            store.apply(frame(batch), version, deleted="gone")
        for i, text, gone in batch:
            latest.pop(i, None)
            if not gone:
                latest[i] = (i, text, False)
        docs = frame(list(latest.values()))
        if version in (1, 4):
            same_index(store.lexical(), docs)
            want = docs.select("doc_id", F.explode(G.acronyms(F.upper("text"))))
            assert rows(store.table("mentions").select("id", "entity")) == rows(want)
    before = store.versions()
    assert before == [0, 1, 2, 3, 4] and store.compact() == 5 and store.versions() == [5]
    same_index(store.lexical(), docs)
    store.apply(frame([(1, "after the fold", False)]), 6)
    assert store.versions() == [5, 6] and store.versions(before=5) == before
    latest[1] = (1, "after the fold", False)
    same_index(store.lexical(), frame(list(latest.values())))


def test_a_stream_that_is_replayed(spark, tmp_path, texts):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    for i in range(0, 150, 50):
        spark.createDataFrame(texts[i : i + 50], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    store = P.PostingStore(spark, index, tokens)
    store.follow(stream(), str(tmp_path / "c1")).awaitTermination()
    store.follow(stream(), str(tmp_path / "c2")).awaitTermination()  # a lost checkpoint: all batches come again
    assert store.versions() == [0, 1, 2]
    same_index(store.lexical(), spark.createDataFrame(texts, SCHEMA))


def test_search_is_exact_and_skips_blocks(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 5)
    docs = spark.createDataFrame([*texts, *[(1000 + i, "w0 w1 w2 w3 " * 3 + ("w50 w51" if i % 30 == 0 else ""), False) for i in range(300)]], SCHEMA)
    questions = spark.createDataFrame([(1, "w0 w1 w50 w51 w51"), (2, "w40"), (3, "nothing of it"), (4, "w0 w0 w1"), (5, "")], "query_id long, text string")
    store = P.PostingStore(spark, str(tmp_path / "index"), tokens)
    store.apply(docs.filter("doc_id < 1100"), 0)
    store.apply(docs.filter("doc_id >= 1100").union(docs.filter("doc_id = 3")), 1)
    for k in (1, 7):
        plan = store.plan(questions, tokens(F.col("text")), k)
        want = L.search(L.build(docs, tokens(F.col("text"))), questions, tokens(F.col("text")), k, pad=False)
        assert rows(plan["best"].select("query_id", "id", "rank", F.round("score", 6))) == rows(want.select("query_id", "id", "rank", F.round("score", 6)))
        count = lambda df: df.filter("query_id = 1").count()
        assert 0 < count(plan["read"]) < 0.5 * count(plan["met"])


def test_stored_tables_are_the_lazy_ones(spark, texts):
    docs = spark.createDataFrame([*texts, (500, None, False), (501, "", False)], SCHEMA)
    same_index(L.build_stored(docs, tokens(F.col("text"))), docs)
