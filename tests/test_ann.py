from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ann, vectors

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], SCHEMA)


def brute(rows, asked, k):
    kept = sorted((i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None)
    out = {}
    for q, v in asked:
        scores = [(-round(float(np.array(v, np.float32).astype(float) @ x), 6), i) for i, x in kept]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.fixture
def vectors_with_copies():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, centres[i % 12] + 0.3 * rng.normal(size=16)) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(150)] + [(900, None), (901, np.zeros(16))]  # a third are one vector
    return rows, [(i, rows[i * 7][1]) for i in range(40)]


def test_exact_search_equals_brute_force(spark, vectors_with_copies, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_QUESTIONS", 9)
    rows, asked = vectors_with_copies
    index = ann.InvertedLists.build(table(spark, rows), lists=12)
    blocks = index.rows.groupBy("list", "block").count().collect()
    assert max(r["count"] for r in blocks) < 100 and index.rows.count() == sum(v is not None for _, v in rows)
    got = by_query(index.search(table(spark, asked).withColumnRenamed("vec_id", "query_id"), 10))
    assert got == brute(rows, asked, 10)


def test_probes_reach_recall_and_skip_lists(spark, vectors_with_copies):
    rows, asked = vectors_with_copies
    index = ann.InvertedLists.build(table(spark, rows), lists=12)
    questions = table(spark, asked).withColumnRenamed("vec_id", "query_id")
    found = index.search(questions, 5, probes=3)
    assert 1 <= index.probes_for(5, 0.9, 50) <= index.probes_for(5, 1.0, 50) < 12
    exact = vectors.flat_topk(table(spark, rows), questions, 5)
    assert ann.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_recall_on_the_given_vectors(spark):
    from textloom.queries.vectors import lists_recall

    assert lists_recall(spark, "/root/testdata/sf0.01").agg(F.avg("recall")).first()[0] >= 0.9


def test_many_questions_meet_blocks(spark, vectors_with_copies, monkeypatch):
    rows, asked = vectors_with_copies
    monkeypatch.setattr(vectors, "BLOCK", 10)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_QUESTIONS", 11)
    assert by_query(vectors.flat_topk(table(spark, rows), table(spark, asked).withColumnRenamed("vec_id", "query_id"), 7)) == brute(rows, asked, 7)


def test_small_stores(spark):
    none = ann.InvertedLists.build(table(spark, []))
    asked = table(spark, [(1, [1, 0]), (2, None)]).withColumnRenamed("vec_id", "query_id")
    assert none.search(asked, 3).count() == 0
    one = ann.InvertedLists.build(table(spark, [(5, [1, 2]), (6, None)]))
    assert by_query(one.search(asked, 3)) == {1: [5]}
    store = vectors.ListStore(lists=2, cosine=True)
    store.build(table(spark, [(1, [10, 0]), (2, [0, 0]), (3, [1, 1]), (4, [0, 3])]))
    assert by_query(store.search(asked, 2)) == {1: [1, 3]}
    store.teardown()
    with pytest.raises(RuntimeError):
        store.search(asked, 2)
