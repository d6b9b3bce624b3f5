from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions import providers as P
from textloom.operators import entities as G
from textloom.operators import language as N
from textloom.sources import main_content as M


def test_blocks_and_content(spark):
    long = "this is a paragraph with more than ten words that say something of a kind"
    pages = [
        f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a>More &amp; more</a></li></ul></nav><div class=ad>Buy now</div><h1>A head</h1><p>{long}</p><p>{long}<br>{long}</p><script>no()</script><footer><a>{long}</a></footer></body></html>",
        None,
        "",
        "only a few words",
        f"<p>{long} {long} <a href=y>and a link</a></p>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    rows = {r["i"]: r for r in df.select("i", M.main_text(F.col("html")).alias("t"), M.page_blocks(F.col("html")).alias("b")).collect()}
    assert rows[0]["t"] == f"A head\n{long}\n{long}\n{long}" and rows[1]["t"] is None and rows[2]["t"] is None and rows[3]["t"] is None
    assert rows[4]["t"] == f"{long} {long} and a link" and rows[4]["b"][0]["links"] == len("and a link")
    assert [(b["text"], b["links"] == b["chars"]) for b in rows[0]["b"]][:4] == [("Home", True), ("More & more", True), ("Buy now", False), ("A head", False)]


@pytest.mark.parametrize("size", [1, 3, 512])
def test_blocks_of_a_long_chunk_give_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(G, "PAIR_BLOCK", size)
    held = {"a": [f"e{i}" for i in range(23)], "b": ["e1", "e2"], "c": ["x"], "d": ["y", "x", "e22"]}
    rows = [(e, c) for c, es in held.items() for e in es]
    got = [tuple(r) for r in G.neighbours(spark.createDataFrame(rows, "entity string, chunk_id string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for es in held.values() for x in es for y in es if x != y}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = N.learn(docs.filter("doc_id % 3 <> 0"))
    rows = docs.filter("doc_id % 3 = 0").select("lang", N.distribution(F.col("text"), profiles).alias("found")).withColumn("said", P.primary_language(F.col("found"))).filter("size(found) > 0").collect()
    assert len(rows) > 200 and sum(r["said"] == r["lang"] for r in rows) / len(rows) > 0.95
    assert all(r["found"] == sorted(r["found"], key=lambda x: -x["probability"]) and all(x["probability"] >= N.LEAST for x in r["found"]) for r in rows)


def test_mixed_short_and_long_texts(spark, monkeypatch):
    en, fr = "the cat and the dog were in the house with all of their friends and they sang. ", "le chat et le chien sont dans la maison avec les amis qui chantent pour nous. "
    labelled = spark.createDataFrame([("en", en * 5), ("fr", fr * 5), (None, en), ("fr", None)], "lang string, text string")
    profiles = N.learn(labelled)
    texts = [en * 4 + fr * 4, "short", None, "1234567890 " * 9, en * 3, en * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["d"] for r in df.select("i", N.distribution(F.col("text"), profiles).alias("d")).collect()}
    assert {x["language"] for x in got[0]} == {"en", "fr"} and all(0.3 < x["probability"] < 0.7 for x in got[0])
    assert got[1] is None and got[2] is None and got[3] == [] and got[4][0]["language"] == got[5][0]["language"] == "en" and len(got[4]) == 1
    assert N.Profiles([], profiles.logs[:, :0]).languages == [] and N.learn(labelled.limit(0)).languages == []
    whole = profiles.shares(en + fr)
    monkeypatch.setattr(N, "_BLOCK", N.PIECE)
    assert abs(profiles.shares(en + fr) - whole).max() < 1e-6
