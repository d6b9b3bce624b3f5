from __future__ import annotations

from textloom import registry
from textloom.operators import datasets as D


def test_keys_meet_a_document_once(spark, tmp_path):
    words = [f"w{i * 7919 % 5003}" for i in range(4000)]
    spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "short one")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["eval_remap"](spark, str(tmp_path))
    assert df.count() == 10
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and plan.count("Join") <= 2  # keys do not become rows beside texts


def test_first_key_then_first_chunk(spark):
    text = "x" * 10 + "a" * 60 + "b" * 60 + "y" * 20
    queries = spark.createDataFrame([("q", "o", 1), ("gone", "none", 1), ("lost", "o", 2), ("other", "p", 1)], "query_id string, chunk_id string, doc long")
    old = spark.createDataFrame([("o", text), ("p", "nothing of this kind")], "chunk_id string, text string")
    new = spark.createDataFrame([(1, 0, "n0", "a" * 70), (1, 2, "n2", text), (1, 1, "n1", "-" + text)], "doc long, chunk_index int, chunk_id string, text string")
    got = {r["query_id"]: (r["chunk_id"], r["status"]) for r in D.remap(queries, old, new).collect()}
    assert got == {"q": ("n1", "ok"), "gone": (None, "semantic_chunk_missing"), "lost": (None, "doc_missing"), "other": (None, "no_match")}
