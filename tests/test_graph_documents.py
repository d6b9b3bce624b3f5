from __future__ import annotations

from textloom import registry

HELD = {1: {"nato", "john smith"}, 2: {"nato", "ibm"}, 3: {"ibm", "mary jones"}, 4: {"usa"}, 5: {"서울시", "대한민국"}}
ASKED = {1: {"nato"}, 2: {"usa", "unesco"}}


def test_the_graph_is_built_from_entities_of_documents(spark, tmp_path):
    texts = ["we met John Smith of NATO", "the NATO and IBM", "here IBM met Mary Jones", "word " * 5000 + "USA", "서울시 대한민국", None]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "what is NATO"), (2, "is USA in UNESCO"), (3, "no names")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: registry.queries()[f"{name}_documents"](spark, str(tmp_path)).collect()
    edges = {(a, b) for held in HELD.values() for a in held for b in held if a != b}
    assert sorted((r["e1"], r["e2"]) for r in run("cooccurrence")) == sorted(edges)
    stats = run("graph_stats")[0]
    assert (stats["entities"], stats["chunks"], stats["edges"]) == (len(set().union(*HELD.values())), len(HELD), len(edges) // 2)
    direct = {(q, d): len(asked & held) / len(asked) for q, asked in ASKED.items() for d, held in HELD.items() if asked & held}
    near = {q: {b for a, b in edges if a in asked} - asked for q, asked in ASKED.items()}
    hop = {(q, d): 0.5 / len(ASKED[q]) for q in ASKED for d, held in HELD.items() if held & near[q] and (q, d) not in direct}
    assert hop
    assert {(r["query_id"], r["id"]): r["score"] for r in run("graph_direct")} == direct
    assert {(r["query_id"], r["id"]): r["score"] for r in run("graph_onehop")} == direct | hop
    assert {(r["query_id"], r["id"]): r["score"] for r in run("graph_search")} == direct | hop
