from __future__ import annotations

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import classifier as K
from textloom.operators import guardrails as P
from textloom.sources import keyed, tables
from textloom.streaming import stage_log

START = datetime(2024, 1, 1)


def test_upserts_by_key(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "name", 8)
    frame = lambda rows: spark.createDataFrame(rows, "name string, seq int, text string, gone boolean")
    assert table.read() is None
    table.upsert(frame([("a", 1, "one", False), ("a", 2, "two", None), ("b", 1, "x", False), (None, 1, "n", False)]), F.col("seq"), "first", "gone")
    before = table.read()
    assert sorted(map(tuple, before.collect())) == [("a", 2, "two"), ("b", 1, "x")]
    for _ in range(2):  # a replayed batch is one version
        assert table.upsert(frame([("b", 3, None, True), ("c", 1, "new", False)]), F.col("seq"), "second", "gone") == 1
    assert sorted(map(tuple, table.read().collect())) == [("a", 2, "two"), ("c", 1, "new")]
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, table.read(0).collect()))  # readers of a version keep it
    assert table.versions() == [0, 1]


def test_writers_at_once_leave_one_row_a_key(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    failed = []

    def write(i: int) -> None:
        try:
            table.upsert(spark.createDataFrame([(k, i, i * 10 + k) for k in range(6)], "k int, seq int, v int"), F.col("seq"), f"batch {i}")
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = table.read().collect()
    assert not failed and sorted(r["k"] for r in rows) == list(range(6)) and len({r["seq"] for r in rows}) == 1 and table.versions() == [0, 1, 2]


def test_stage_events_once_in_table_and_stream(spark, tmp_path):
    rows = [(q, s, START + timedelta(seconds=t)) for q, s, t in (("1", "guard", 0), ("1", "retrieve", 2), ("1", "answer", 5), ("2", "guard", 1), ("2", "blocked", 1.5))]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "query_id string, stage string, at timestamp"
    want = sorted(tuple(r) for r in stage_log.stage_events(spark.createDataFrame(rows + rows[:2], kind)).collect())
    assert [(r[0], r[1], r[2], r[4]) for r in want] == [("1", "answer", 3, 3.0), ("1", "guard", 1, 0.0), ("1", "retrieve", 2, 2.0), ("2", "blocked", 2, 0.5), ("2", "guard", 1, 0.0)]
    for part in (rows[:2], rows[1:4], rows):  # later files repeat earlier events
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        q = stage_log.follow_stages(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).select("query_id", "stage", "nth", "at", "elapsed").collect()) == want


def test_a_fitted_scorer_in_the_guardrails(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    scorer, sweep = K.fit(docs.filter(~test).select("text", "label"))
    assert sweep.count() == len(K.STEPS) and 0 < scorer.threshold < 1
    rows = docs.filter(test).select("label", (scorer.column(F.col("text")) >= scorer.threshold).alias("said")).collect()
    hit = sum(r["said"] and r["label"] == 1 for r in rows)
    assert hit / max(1, sum(r["said"] for r in rows)) > 0.9 and hit / sum(r["label"] == 1 for r in rows) > 0.8
    asked = docs.filter(test).select("label", "text", F.lit("xx").alias("language")).limit(200)
    blocked = P.check_input(asked, toxic=scorer.scorer())
    same = blocked.filter(F.array_contains("reasons", "toxicity") != (scorer.column(F.col("text")) >= scorer.threshold))
    assert same.count() == 0
    empty = spark.createDataFrame([(None,), ("",), ("  .",)], "text string")
    assert [r[0] for r in empty.select(scorer.column(F.col("text"))).collect()] == [0.0] * 3


def test_corpus_document_and_samples(spark, tmp_path):
    meta = spark.createDataFrame([("a.pdf", False, "en", "fixed"), ("b.pdf", True, "en", "fixed"), ("c.pdf", None, "ko", "semantic")], "filename string, is_duplicate boolean, primary_language string, chunking_strategy_used string")
    chunks = spark.createDataFrame([("a.pdf", 1, " second ", 2), ("a.pdf", 0, "first", 1), ("b.pdf", 0, "copy", 1), ("c.pdf", 0, " ", 0), ("c.pdf", 1, "x", 1)], "filename string, chunk_index int, text string, token_count int")
    assert {(r["chunk_id"], r["text"], r["language"]) for r in tables.load_corpus(meta, chunks).collect()} == {("a.pdf__0", "first", "en"), ("a.pdf__1", "second", "en"), ("c.pdf__1", "x", "ko")}
    [one] = tables.document(meta, chunks, "a.pdf").collect()
    assert [c["text"] for c in one["chunks"]] == ["first", " second "] and tables.document(meta, chunks, "none").count() == 0
    rows = spark.range(100).withColumn("g", F.col("id") % 4)
    drawn = tables.sample_by_group(rows, "g", 5, "id")
    assert {r["count"] for r in drawn.groupBy("g").count().collect()} == {5} and drawn.exceptAll(tables.sample_by_group(rows, "g", 5, "id")).count() == 0
    tables.write_csv(meta.select("filename"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3
    tables.assert_same_size(meta, meta, "same")
    with pytest.raises(ValueError, match="sizes: 3 and 5 rows"):
        tables.assert_same_size(meta, chunks, "sizes")
    log = tables.stage_log(spark.createDataFrame([(1, "answered"), (2, "blocked_input")], "query_id int, route string"), ["guard", "retrieve", "answer"])
    assert sorted(map(tuple, log.select("query_id", "nth", "stage").collect())) == [(1, 0, "guard"), (1, 1, "retrieve"), (1, 2, "answer"), (2, 0, "guard")]


def test_repeated_windows(spark):
    block = "this very passage is over forty characters "
    texts = [block * 2 + "end", block + "x" * 41, "ab" * 39, "ab" * 40, "z" * 79, "z" * 80, None, "", (block + "and so on " * 3) * 2000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.repeats(F.col("t"))).collect()]
    brute = lambda t: any(t[i : i + 40] in t[i + 40 :] for i in range(len(t) - 39))
    assert got[:6] == [brute(t) for t in texts[:6]] and got[6] is None and got[7:] == [False, True]
