from __future__ import annotations

import random

from textloom.operators import entities as G
from textloom.operators import vectors as V


def test_best_chunks_are_those_of_all_scores_without_edges(spark, monkeypatch):
    rng = random.Random(9)
    held = {(f"e{min(rng.randrange(60), rng.randrange(60))}", c) for c in range(150) for _ in range(rng.randint(0, 4))} | {("lone", 7), ("lone", 8)}
    asked = {(q, f"e{rng.randrange(75)}") for q in range(40) for _ in range(rng.randint(1, 4))} | {(90, "lone"), (91, "nowhere"), (92, "lone"), (92, "e59")}
    mention = spark.createDataFrame(sorted(held), "entity string, chunk_id long")
    queries = spark.createDataFrame(sorted(asked), "query_id long, entity string")
    want = G.graph_search(G.graph_scores(queries, mention, G.neighbours(mention)), 6)
    rows = lambda df: {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in df.collect()}
    want = rows(want)
    assert any(s < 1 / 4 for _, s in want.values())  # chunks over a neighbour are among them
    monkeypatch.setattr(G, "neighbours", None)
    assert rows(G.graph_topk(queries, mention, 6)) == want


def test_flat_search_ranks_by_six_places_before_ids(spark):
    rows = spark.createDataFrame([(i, [1.0, i * 1e-9]) for i in range(30)], "vec_id long, embedding array<double>")
    found = V.flat_topk(rows, rows.filter("vec_id = 29").withColumnRenamed("vec_id", "query_id"), 5)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
