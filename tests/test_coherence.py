from __future__ import annotations

import pytest

from textloom import registry
from textloom.operators import chunking as C

TEXTS = ["One about cats. Two about cats! Three of dogs? " * 40 + "A last one on ships.", "only one sentence", "", None, "Ships sail. " * 300 + "Dogs bark. " * 200]


def _cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5 + 1e-10)


def test_coherence_reads_a_document_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()["chunk_coherence"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
    want = {}
    for i, text in enumerate(TEXTS, 1):
        chunks = C.semantic_chunks(text)
        parts = [[C.hashed_embedding(s) for s in C._SENTENCE.split(c["text"].strip())] for c in chunks]
        bare = ["".join(C.Tokenizer().split(c["text"])[c["overlap_prefix_tokens"] or 0 :]).strip() for c in chunks]
        heads = [C.hashed_embedding(C._SENTENCE.split(b)[0]) for b in bare]
        intra = [_cos(a, b) for p in parts for a, b in zip(p, p[1:])]
        across = [_cos(p[-1], h) for p, h in zip(parts, heads[1:])]
        if chunks:
            want[i] = tuple(sum(x) / len(x) if x else None for x in (intra, across))
    got = {r["doc_id"]: (r["intra"], r["boundary"]) for r in df.collect()}
    assert set(got) == set(want) and any(b is not None for _, b in want.values())
    for i, pair in want.items():
        assert got[i] == tuple(x if x is None else pytest.approx(x, abs=1e-6) for x in pair)
