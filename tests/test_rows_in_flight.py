"""Texts and what is made of them go to Python and back by rows; an Arrow batch holds those of 10,000 documents."""

from __future__ import annotations

import pytest

from textloom import registry


@pytest.mark.parametrize("name", ["chunk_semantic", "chunk_recursive", "clean_text", "graph_stats_documents"])
def test_no_batch_holds_thousands_of_texts(spark, tmp_path, name):
    spark.createDataFrame([(1, "One. Two of NATO and IBM."), (2, None), (3, "ﬁne"), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    rows = df.collect()
    if name == "clean_text":
        assert {r["doc_id"]: r["cleaned"] for r in rows} == {1: "One.\n Two of NATO and IBM.", 2: "", 3: "fine", 4: ""}
    elif name != "graph_stats_documents":
        assert {r["doc_id"] for r in rows} == {1, 3}
