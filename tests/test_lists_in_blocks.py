from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import ann


def test_a_question_is_sent_once_to_a_block_and_not_to_each_list(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_ROWS", 64)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)]
    rows += [(500 + i, [x + 1e-8 for x in rows[i][1]]) for i in range(40)]  # ties to six places, where the smaller id comes first
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.InvertedLists.build(df, lists=40)
    assert index.blocks <= 18 and index.rows.select("block").distinct().count() == index.blocks < 40
    assert index.rows.groupBy("block").count().agg(F.max("count")).first()[0] <= 2 * 64
    asked = df.filter("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    found = index.search(asked, 7)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    x = np.array([v for _, v in rows])
    for q, ids in got.items():
        s = np.round(x @ x[q], 6)
        assert ids == list(np.lexsort((np.arange(len(x)), -s))[:7])
    assert len(got) == 60
