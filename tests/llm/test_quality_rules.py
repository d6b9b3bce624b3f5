from __future__ import annotations

import re
from collections import Counter

from textloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(cover),
        "base_failed": len(w) < 10 or 100 * len(cover) > 20 * len(w),
    }


HARD = [None, "", " \n\t ", "one", "a b c d e a b c d e", "a a a a a a a a a a a a", "x y z\nx y z\n\nx y z \n", "# * $ % & | < > é😀 \x0b\x0c w", "a b c d e f " * 4000, " ".join(f"w{i}" for i in range(20000)), "a b c d e f g h i j k l m n"]


def test_base_against_brute(spark, docs, corpus):
    texts = HARD + [r["text"] for r in corpus]
    for r in Q.judge(docs(texts)).collect():
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_line_frequency_removes_and_rejects(spark, docs):
    common = "this very common footer line has quite a few words in it"
    clean = [f"document {i} talks about subject {i * 7} with words " + " ".join(f"u{i}x{k}" for k in range(30)) for i in range(60)]
    texts = [f"{c}\n{common}" for c in clean[:30]] + clean[30:] + [f"tiny{i}\n{common}" for i in range(10)] + [clean[59]] * 40
    # alphabetic spelling keeps digits from being folded into one line
    texts = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t) for t in texts]
    rows = {r["doc_id"]: r for r in Q.judge(docs(texts), host_share=0.0).collect()}
    assert all(rows[i]["kept"] and rows[i]["lost_lines"] == 1 for i in range(30))
    assert all(rows[i]["kept"] and rows[i]["lost_lines"] == 0 for i in range(30, 60))
    assert all(not rows[i]["kept"] for i in range(60, 70))
    assert all(rows[i]["kept"] for i in range(70, 110))  # copies of one text are one document
    out = {r["doc_id"]: r for r in Q.clean(docs(texts), host_share=0.0).collect()}
    assert set(out) == {i for i in rows if rows[i]["kept"]}
    assert out[0]["text"] == texts[0].split("\n")[0] and out[0]["n_chars"] == len(out[0]["text"])
    assert out[40]["text"] == texts[40]


def test_null_host_and_empty(spark, docs):
    assert Q.judge(docs([])).count() == 0
    assert Q.judge(docs(["a b c d e f g h i j k", None], sources=[None, None])).filter("kept").count() == 1
    assert Q.clean(docs([])).columns == docs([]).columns


def test_repeated_rows_and_null_ids(spark, docs):
    footer = " ".join(f"foot{i}" for i in range(11))
    texts = [" ".join(f"d{i}w{k}" for k in range(24)) + "\n" + footer for i in range(40)]
    df = docs(texts)
    rows = [tuple(r) for r in df.collect()]
    once = {r["doc_id"]: (r["lost_lines"], r["lost_words"], r["kept"]) for r in Q.judge(df).collect()}
    assert once[3] == (1, 11, True)
    more = spark.createDataFrame([*rows, rows[3], rows[3], (3, "other text\n" + footer, *rows[3][2:]), (None, *rows[5][1:]), (3, rows[3][1], "en", "elsewhere", 1)], df.schema)
    judged = Q.judge(more).collect()
    assert len(judged) == 45
    found = sorted((r["lost_lines"], r["lost_words"], r["kept"]) for r in judged if r["doc_id"] == 3)
    assert found == sorted([(1, 11, True)] * 3 + [(1, 11, False)] + [(0, 0, True)])
    assert [(r["lost_lines"], r["kept"]) for r in judged if r["doc_id"] is None] == [(1, True)]
    kept = Q.clean(more).collect()
    assert len(kept) == sum(r["kept"] for r in judged) and sum(footer in r["text"] for r in kept) == 1  # in the other host


def test_a_hot_host_has_a_bound(spark, docs):
    from pyspark.sql import functions as F

    texts = docs([f"text {i}" for i in range(3_000)] ).select(F.col("source").alias("host"), F.xxhash64("text").alias("content"))
    lines = texts.limit(150).withColumn("line", F.lit(1).cast("long"))
    assert Q.boilerplate(lines, texts, max_docs=100).count() == 1
    assert Q.boilerplate(lines, texts, max_docs=200, host_share=0.1).count() == 0
