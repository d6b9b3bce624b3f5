from __future__ import annotations

import zlib

from textloom.llm import sharding as S


def test_tree_is_best_fit():
    runs = S.best_fit([(0, 1, 6.0), (1, 1, 5.0), (2, 1, 4.0), (3, 2, 3.0)], [0, 1], 11.0)
    assert runs == [(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 2, 1)]
    assert S.best_fit([(0, 3, 6.0)], [0, 1], 10.0) is None
    tree = S.BinTree()
    for i, room in enumerate([5.0, 9.0, 7.0, 7.0]):
        tree.add(room, i)
    assert tree.take(6.0) == (7.0, 2) and tree.take(6.0) == (7.0, 3) and tree.take(6.0) == (9.0, 1) and tree.take(6.0) is None


def test_assign(spark, docs, corpus):
    texts = [None, "", "", "é"] + [r["text"] for r in corpus] + ["copy of one text"] * 40
    rows = S.assign(docs(texts)).collect()
    assert len(rows) == len(texts)
    by_text, by_shard, used = {}, {}, {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        by_text.setdefault(t, set()).add(r["shard"])
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        used[r["shard"]] = used.get(r["shard"], 0) + r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    largest = max(sum(len((x or "").encode()) + 1 for x in texts if x == t) for t in set(texts))
    assert max(used.values()) - min(used.values()) <= max(largest, 0.02 * sum(used.values()))


def test_oversize_group_gets_its_own_shard(spark, docs):
    texts = ["z" * 1000] * 50 + [f"doc {i} " * 20 for i in range(300)]
    rows = S.assign(docs(texts), shards=4).collect()
    assert {r["shard"] for r in rows if r["doc_id"] < 50} & {r["shard"] for r in rows if r["doc_id"] >= 50} == set()


def test_repeated_ids_and_empty(spark, docs):
    df = docs(["a", "a", "b"])
    rows = S.assign(df.union(df)).collect()
    assert len(rows) == 6 and len({(r["shard"], r["slot"]) for r in rows}) == 6
    assert S.assign(docs([])).count() == 0
