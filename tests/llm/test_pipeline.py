from __future__ import annotations

import random

import corpus_pipeline
from textloom.llm import queries


def test_stages_and_queries():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "PII", "packing"]
    named = __spark_entry__.queries()
    assert "pipeline" in named and all(any(k.startswith(f"op{n}_") for k in named) for n in range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_decisions_take_effect(spark, docs, corpus):
    rng = random.Random(9)
    pool = sorted({w for r in corpus if r["lang"] == "en" for w in r["text"].split() if w.isalpha()})
    clean = [" ".join(rng.choice(pool) for _ in range(120)) for _ in range(40)]
    texts = [*clean, clean[0], clean[1].replace(clean[1].split()[60], "other", 1), "too short", "again " * 60, None, clean[2] + " mail a.b@c.org"]
    df = docs(texts)
    columns, kept = df.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "")
        assert df.columns == columns, name
        df = spark.createDataFrame(df.collect(), df.schema)
        kept.append({r["doc_id"]: r["text"] for r in df.collect()})
    assert set(kept[0]) == {*range(42), 45}
    assert set(kept[1]) == set(kept[0])
    assert set(kept[2]) == {*range(40)}
    # document 2 and its copy with an address are near copies: the smaller id stays
    packed = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])


def test_copies_with_a_fifth_of_text_added_or_removed_go(spark, docs):
    words = [f"w{i}" for i in range(200)]
    scattered = [f"x{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(words)]
    texts = [words, words + [f"tail{i}" for i in range(40)], words[:165], scattered, [f"other{i}" for i in range(200)]]
    kept = {r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs([" ".join(t) for t in texts]), "").collect()}
    assert kept == {0, 4}


def test_run(spark):
    from pathlib import Path

    from textloom.llm.common import shared_dir

    place = Path(shared_dir(spark).removeprefix("file://"))
    before = set(place.iterdir()) if place.exists() else set()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len([p for p in set(place.iterdir()) - before if p.name.startswith("textloom-")]) == 1  # the last stage alone
    assert out.count() > 100 and "batch" in out.columns
