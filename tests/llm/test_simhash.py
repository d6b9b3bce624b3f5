from __future__ import annotations

import hashlib

from textloom.llm import simhash as S


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        out.append(t[: len(t) - half] + nxt[:half])
    return out


def check(df, texts):
    rows = {r["doc_id"]: r for r in S.report(df).collect()}
    assert len(rows) == len(texts)
    fps = [int(rows[i]["fingerprint"], 16) for i in range(len(texts))]
    for i, e in enumerate(edited(texts)):
        r = rows[i]
        assert r["n_chars"] == len(texts[i] or "") and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == 1 - (fps[i] ^ int(r["edited_fingerprint"], 16)).bit_count() / 64
        assert r["near_next"] == 1 - (fps[i] ^ fps[(i + 1) % len(fps)]).bit_count() / 64
        near = sum((fps[i] ^ f).bit_count() <= S.RADIUS for f in fps) - 1
        assert r["n_within_radius"] == (near if i % 100 == 0 else None)
    return rows, fps


def test_corpus(spark, docs, corpus):
    texts = [r["text"] for r in corpus] + [None, "", "é😀", corpus[0]["text"], corpus[100]["text"] + " tail", "w " * 30000]
    rows, fps = check(docs(texts), texts)
    assert fps[0] == fps[203] and fps[200] == fps[201] == 0
    whole = [r for r in rows.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] for r in whole) > 0.9 * len(whole)


def test_votes_against_plain_python(spark, docs):
    import numpy as np  # noqa: F401

    texts = ["alpha beta beta gamma", "one", ""]
    df = docs(texts)
    hashes = {r["w"]: r["h"] & (2**64 - 1) for r in df.selectExpr("explode(split(text, ' ')) w").selectExpr("w", "xxhash64(w) h").collect()}
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in S.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        ws = t.split()
        all_ = sum(min(len(w), 12) ** 2 for w in ws)
        want = sum(1 << b for b in range(64) if 2 * sum(min(len(w), 12) ** 2 for w in ws if hashes[w] >> b & 1) > all_)
        assert got[i] == want


def test_sparse_ids_many_buckets(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "BUCKET_ROWS", 2)
    monkeypatch.setattr(S, "FAN", 2)
    texts = [f"text number {i} " * (i % 7 + 1) for i in range(40)]
    df = docs(texts).withColumn("doc_id", F.col("doc_id") * F.col("doc_id") * 1000 - 7)
    rows = sorted(S.compare(df).collect(), key=lambda r: r["doc_id"])
    assert [r["edited_sha256"] for r in rows] == [hashlib.sha256(e.encode()).hexdigest() for e in edited(texts)]
    assert [r["next_fp"] for r in rows] == [rows[(i + 1) % 40]["fp"] for i in range(40)]


def largest_bucket(spark, ids):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id long, tie long").withColumn("tie", F.xxhash64("tie"))
    rows = S.bucketed(df)
    placed = sorted(rows.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    assert [r["bucket"] for r in placed] == sorted(r["bucket"] for r in placed)  # ascending with (doc_id, tie)
    return rows.groupBy("bucket").count().agg(F.max("count")).first()[0]


def test_buckets_stay_small(spark):
    assert largest_bucket(spark, [*range(20_000), 10**15]) < 4 * S.BUCKET_ROWS
    assert largest_bucket(spark, [-(2**62), *range(5_000), 2**62]) < 4 * S.BUCKET_ROWS
    assert largest_bucket(spark, [None] * 4_000 + [7] * 4_000 + [*range(4_000)]) < 4 * S.BUCKET_ROWS


def test_uneven_ids_are_cut_by_their_own_quantiles(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 4)
    assert largest_bucket(spark, [*range(20_000), 10**15]) < 4 * S.BUCKET_ROWS
    assert largest_bucket(spark, [2**k + j for k in range(20, 60) for j in range(200)]) < 4 * S.BUCKET_ROWS
    assert largest_bucket(spark, [*range(3_000)] + [3_000] * 1_000 + [3_001] * 1_500 + [10**12]) < 4 * S.BUCKET_ROWS


def test_many_ids_and_one_far_away(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "RANGES", 16)  # as 4096 ranges are to a hundred million ids
    ids = spark.range(400_000, numPartitions=8).union(spark.range(10**15, 10**15 + 1)).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("tie"))
    largest, middle, n = S.bucketed(ids).groupBy("bucket").count().agg(F.max("count"), F.percentile_approx("count", 0.5), F.sum("count")).first()
    assert n == 400_001 and largest < 4 * middle


def test_single_and_empty(spark, docs):
    check(docs(["only one here"]), ["only one here"])
    assert S.report(docs([])).count() == 0


def test_documents_within_the_radius_are_named(spark, docs):
    texts = [f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(110)]
    texts[5], texts[7] = texts[0], texts[100]
    rows = {r["doc_id"]: r for r in S.report(docs(texts)).collect()}
    fps = {i: int(r["fingerprint"], 16) for i, r in rows.items()}
    want = {(i, j, (fps[i] ^ fps[j]).bit_count()) for i in (0, 100) for j in fps if i != j and (fps[i] ^ fps[j]).bit_count() <= S.RADIUS}
    assert {(0, 5, 0), (100, 7, 0)} <= want
    for i in rows:
        listed = rows[i]["fingerprints_within_radius"]
        assert (listed is not None) == (i % 100 == 0)
        if listed:
            assert listed == sorted(set(listed))
            assert {j for j in rows if rows[j]["fingerprint"] in listed} - {i} == {b for a, b, _ in want if a == i}


def test_neighbours_against_all_pairs(spark):
    fps = [(0, 0), (1, 7), (2, 15), (3, -(2**63)), (4, 0), (5, 1 << 40 | 1 << 20 | 1), (6, -1), (7, 2**63 - 1)]
    df = spark.createDataFrame(fps, "doc_id long, fp long")
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(i, j, distance(a, b)) for i, a in fps for j, b in fps if i != j and distance(a, b) <= S.RADIUS}
    found = S.neighbours(df, df).collect()
    assert {(r["doc_id"], r["neighbour"], r["distance"]) for r in found} == want and len(found) == len(want)
