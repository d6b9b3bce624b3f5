from __future__ import annotations

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import langid, packing, weak_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return {r["doc_id"]: r for r in langid.report(df).collect()}, {r["doc_id"]: r for r in df.select("doc_id", "lang").collect()}


def test_language_held_out_accuracy(scored):
    got, docs = scored
    assert len(got) == len(docs)
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edge_rows(spark, docs):
    texts = ["the cat sat on the mat and the dog ran"] * 12 + ["der hund und die katze sind im haus"] * 12 + [None, "", "123 !?", "der hund und die katze"]
    langs = ["en"] * 12 + ["de"] * 12 + ["en", None, "en", None]
    rows = {r["doc_id"]: r for r in langid.report(docs(texts, langs)).collect()}
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (24, 25, 26)] == [("und", 0.0)] * 3
    assert rows[27]["lang_pred"] == "de" and rows[0]["lang_pred"] == "en"
    nothing = langid.report(docs(["text"], [None])).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert langid.report(docs([])).count() == 0
    kept = langid.keep_known(docs(texts, langs).withColumnRenamed("n_chars", "score"))
    assert {r["doc_id"] for r in kept.collect()} == {*range(24), 27} and kept.columns[-1] == "score"


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    samples = []
    for i in range(200):
        y = i % 2
        at = np.unique(np.concatenate([rng.integers(0, 50, 5) + 100 * y, rng.integers(1000, 3000, 8)]))
        samples.append((y if rng.random() > 0.15 else 1 - y, at, np.ones(len(at))))
    model = langid.fit(samples, np.ones(langid.SIZE), ["a", "b"])
    assert (model.weights == 0).mean() > 0.9 and model.temperature > 0


def test_buckets_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40, 9))
        counts = rng.integers(1, 9, len(lengths))
        for k in (1, 2, 3, 20):
            cost = lambda bs: sum(int(c) * (min(b for b in bs if b >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
            tops = [c for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1].tolist(), r)]
            want = min(cost([*c, int(lengths[-1])]) for c in tops)
            got = packing.bucket_lengths(lengths, counts, k)
            assert len(got) <= k and cost(got) == want


def test_pack_keeps_every_token(spark):
    rng = np.random.default_rng(3)
    rows = [(i // 2, int(n)) for i, n in enumerate(rng.integers(1, 300, 400))] + [(None, 1), (7, 2500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), max_tokens=128, buckets=4, budget=512).collect()
    assert sum(r["piece_tokens"] for r in out) == sum(n for _, n in rows)
    assert len(out) == sum(-(-n // 128) for _, n in rows) and len({r["bucket_tokens"] for r in out}) <= 4
    seats = {(r["bucket_tokens"], r["batch"], r["place"]) for r in out}
    assert len(seats) == len(out)
    for b in {r["bucket_tokens"] for r in out}:
        per = 512 // b
        mine = sorted(r["batch"] * per + r["place"] for r in out if r["bucket_tokens"] == b)
        assert mine == list(range(len(mine)))
    assert all(r["padding"] == r["bucket_tokens"] - r["piece_tokens"] >= 0 for r in out)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_weak_quality_against_labels(spark):
    rows = {r["doc_id"]: r for r in weak_quality.report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in rows]
    good = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    bad = [rows[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_em_finds_the_poor_labeler():
    rng = np.random.default_rng(4)
    accuracy = [0.95, 0.9, 0.9, 0.55, *[0.85] * (len(weak_quality.LABELERS) - 4)]
    found = {}
    for _ in range(4000):
        y = rng.random() < 0.7
        v = "".join("+" if (rng.random() < a) == y else "-" for a in accuracy)
        found[v] = found.get(v, 0) + 1
    _, right = weak_quality.estimate(sorted(found.items()))
    got = [right[n] for n in weak_quality.LABELERS]
    assert got[3] == min(got) and all(abs(g - a) < 0.07 for g, a in zip(got, accuracy, strict=True))


def test_weak_quality_edges(spark, docs):
    rows = {r["doc_id"]: r for r in weak_quality.report(docs([None, "", "word", "a fine long text. " * 30])).collect()}
    assert rows[0]["score"] == rows[1]["score"] == 0.0 and not rows[0]["kept"]
    assert weak_quality.report(docs([])).count() == 0


def test_packed_ids_are_the_encoders(spark, docs, corpus):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    texts = [r["text"] for r in corpus[:80]] + [None, "", "ab cd " * 30_000]
    packed = packing.pack(packing.encoded(docs(texts), path), max_tokens=512, buckets=4, budget=2048)
    rows = sorted(packing.padded(packed, pad_id=7).join(packed.select("doc_id", "piece", F.col("ids").alias("bare")), ["doc_id", "piece"]).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    got = {}
    for r in rows:
        ids = np.frombuffer(r["bare"], "<u2").tolist()
        assert len(ids) == r["piece_tokens"]
        assert np.frombuffer(r["ids"], "<u2").tolist() == ids + [7] * r["padding"]
        got.setdefault(r["doc_id"], []).extend(ids)
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}


def test_blocks_of_grams_are_the_whole(monkeypatch):
    from textloom.llm import grams

    text = "Grüße an ΑΣ, İ and all " * 40
    whole = sorted(np.concatenate(list(grams.grams(text))).tolist())
    for block in (1, 2, 3, 50, len(text.lower()) + 1):
        monkeypatch.setattr(grams, "BLOCK", block)
        assert sorted(np.concatenate(list(grams.grams(text))).tolist()) == whole
    votes = weak_quality.votes(text * 3)
    monkeypatch.setattr(weak_quality, "PIECE", 37)
    assert weak_quality.votes(text * 3) == votes


def test_long_texts(spark, docs):
    long = "these are the words of a text that does not end " * 110_000  # five million characters
    df = docs([long, *["some short text of the same kind here"] * 30], langs=["en"] * 15 + ["de"] * 16)
    assert {r["doc_id"] for r in langid.report(df).collect()} == {*range(31)}
    assert weak_quality.report(df).count() == 31


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_ids_do_not_decide_what_is_learned(spark, ids):
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)  # a training document
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.lit(None if ids == "null" else one).cast("long"))
    said = langid.report(df.select("doc_id", F.concat("text", F.lit(" \n"), "lang").alias("text"), "lang")).select("lang_pred").groupBy("lang_pred").count().collect()
    assert {r["lang_pred"] for r in said} >= {"de", "en", "es", "fr"} and all(r["count"] < 900 for r in said)
    kept = [r["kept"] for r in weak_quality.report(df).collect()]
    assert 0.6 < np.mean(kept) < 0.99
    copies = spark.createDataFrame([(None, "the same short text of a few words", "en")] * 3000, "doc_id long, text string, lang string")
    rows = langid.report(copies).collect()
    assert len(rows) == 3000 and {r["lang_pred"] for r in rows} == {"en"}


def test_the_sample_is_bounded_in_rows_and_features(spark, docs, monkeypatch):
    df = docs([f"text {i} " * (1 + i % 3) for i in range(60)], langs=["en", "de", "fr"] * 20)
    for bound in (1, 7, 100):
        by_lang = langid.first_by_hash(df, bound, "lang").groupBy("lang").count().collect()
        assert {r["count"] for r in by_lang} == {min(bound, 20)}
        assert langid.first_by_hash(df, bound).count() == min(bound, 60)
    copies = df.limit(1).union(df.limit(1)).union(df.limit(1))
    assert langid.first_by_hash(copies, 2).count() == 2 and langid.first_by_hash(docs([]), 2).count() == 0
    monkeypatch.setattr(langid, "FEATURES", 5)
    assert {len(at) for _, at, _ in langid.sample_rows(df, F.col("lang"), langid.shares)} == {5}
