from __future__ import annotations

from textloom import registry


def test_answers_in_every_chunk_and_tokens_of_every_document(spark, tmp_path):
    texts = [" ".join(f"word{i}" for i in range(1500)), "A short text"]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.queries()["eval_remap"](spark, str(tmp_path)).collect()
    chunks = registry.queries()["chunk_fixed"](spark, str(tmp_path)).count()
    assert chunks > 3 and len({r["query_id"] for r in rows}) == len(rows) == chunks
    assert all(r["status"] == "ok" and r["chunk_id"].split("__")[0] == r["query_id"].split("__")[0] for r in rows)
    assert len({r["chunk_id"] for r in rows}) > 2
    tokens = {r["doc_id"]: r["tokens"] for r in registry.queries()["tokens_by_script"](spark, str(tmp_path)).collect()}
    assert tokens[2] == "a|short|text" and tokens[1].count("|") == 1499 and min(tokens) < 0
