from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import datasets as D


@pytest.mark.parametrize("limit", [7, 40, 200_000])
def test_val_has_its_exact_size(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "SPLIT_RANGE", limit)
    rows = [(i, (i * 37) % 101) for i in range(100)] + [(200 + i, 5) for i in range(60)]  # many equal keys where the cut falls
    out = D.train_val_split(spark.createDataFrame(rows, "id int, k int"), [F.col("k")])
    got = out.collect()
    assert out.columns == ["id", "k", "part"] and sorted((r["id"], r["k"]) for r in got) == sorted(rows)
    val = [r["k"] for r in got if r["part"] == "val"]
    assert sorted(val) == sorted(k for _, k in rows)[:16]


def test_few_or_equal_rows(spark):
    parts = lambda rows: sorted(r["part"] for r in D.train_val_split(spark.createDataFrame(rows, "id int"), [F.col("id")]).collect())
    assert parts([(1,), (2,)]) == ["val", "val"] and parts([(4,)] * 5) == ["train", "train", "val", "val", "val"] and parts([]) == []


def test_search_keys(spark):
    text = "".join(chr(97 + i % 26) for i in range(400))
    [keys] = spark.createDataFrame([(text,)], "t string").select(D.excerpts(F.col("t"))).first()
    first = [text[140:260], text[100:220], text[180:300], text[80:200], text[200:320]]
    assert keys[:5] == first and keys[15] == text[183:217] and len(keys) == 20
    [short] = spark.createDataFrame([("x" * 100,)], "t string").select(D.excerpts(F.col("t"))).first()
    assert short[0] == "x" * 100 and [len(k) for k in short[1:4]] == [80, 75, 75]
