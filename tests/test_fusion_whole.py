from __future__ import annotations

from textloom import registry
from textloom.queries import vectors


def test_the_second_list_reads_whole_texts(spark, tmp_path):
    texts = ["alpha\nbeta\n\ngamma delta", "alpha beta", "nothing\nhere", "other\n" + "filler " * 500 + "\nalpha beta gamma", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Alpha beta gamma"), (2, "delta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    _, second = vectors._lists(spark, str(tmp_path))
    scores = {(r["query_id"], r["id"]): r["score"] for r in second.collect()}
    assert {k: v for k, v in scores.items() if v} == {(1, 0): 3.0, (1, 3): 3.0, (1, 1): 2.0, (2, 0): 1.0}
    merged = {(r["query_id"], r["id"]): r["score"] for r in registry.queries()["variant_max_merge"](spark, str(tmp_path)).collect()}
    assert merged[1, 3] == 3.0
    for name in ("rrf_fusion", "hybrid_topk", "relative_threshold", "graph_merge"):
        assert (1, 3) in {(r["query_id"], r["id"]) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    spark.catalog.clearCache()
