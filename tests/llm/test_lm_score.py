from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import lm_score as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]  # None ends a text


def plain(rows, order, rounds=L.ROUNDS):
    """The whole result by dictionaries. rows: (id, text, part)."""
    starts = [""] * (order - 1)  # no word is empty
    docs = [(i, [*starts, *tokens(t)], p) for i, t, p in rows]

    def count(parts):
        grams, contexts = Counter(), Counter()
        for _, ws, p in docs:
            if p in parts:
                for at in range(order - 1, len(ws)):
                    for n in range(1, order + 1):
                        grams[n, tuple(ws[at - n + 1 : at + 1])] += 1
                        contexts[n, tuple(ws[at - n + 1 : at])] += 1
        return grams, contexts

    def chances(counts, ws, at, words):
        grams, contexts = counts
        p, bucket = [1 / (words + 1)], L._SPAN
        for n in range(1, order + 1):
            c = contexts[n, tuple(ws[at - n + 1 : at])]
            p.append(grams[n, tuple(ws[at - n + 1 : at + 1])] / c if c else 0.0)
            if n > 1 and c:
                bucket = n * L._SPAN + c.bit_length()
        return bucket, p

    learned, retained = count({L.RETAINED, L.DELETED}), count({L.RETAINED})
    total = learned[1][1, ()]
    vocabulary = {g for (n, g) in learned[0] if n == 1}
    weights = L.start_weights((order + 1) * L._SPAN, order)
    told = [chances(retained, ws, at, len(vocabulary)) for _, ws, p in docs if p == L.DELETED for at in range(order - 1, len(ws))]
    if not total:
        weights[:] = np.eye(1, order + 1)
    elif told and retained[1]:
        for _ in range(rounds):
            sums = np.zeros_like(weights)
            for b, p in told:
                share = [x * w for x, w in zip(p, weights[b], strict=True)]
                for k, x in enumerate(share):
                    sums[b, k] += x / sum(share)
            weights = L.better_weights(sums, order)
        weights = L.filled(weights, sums.sum(1))
    out = []
    for i, ws, p in docs:
        cs = [learned[0][1, (w,)] for w in ws[order - 1 :]]
        said = [chances(learned, ws, at, len(vocabulary)) for at in range(order - 1, len(ws))]
        score = sum(math.log10(sum(x * w for x, w in zip(q, weights[b], strict=True))) for b, q in said)
        out.append((i, p == L.HELD_OUT, len(cs), sum(c > 0 for c in cs), total, sum(math.log10((c + 1) / (total + len(vocabulary) + 1)) for c in cs), score))
    return out


def compare(df, **sizes):
    order = sizes.get("order", L.ORDER)
    text = F.coalesce("text", F.lit(""))
    rows = [tuple(r) for r in df.select("doc_id", "text", L.part(F.col("doc_id"), text)).collect()]
    want = sorted(plain(rows, order), key=lambda r: (r[0] is None, r))
    got = sorted((tuple(r) for r in L.report(df, **sizes).collect()), key=lambda r: (r[0] is None, r))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6, atol=1e-6)
    return got


@pytest.mark.parametrize("sizes", [{}, {"order": 2}, {"order": 4, "block_tokens": 700, "range_tokens": 900}, {"block_tokens": 7, "range_tokens": 5000}, {"order": 1}])
def test_against_plain_version(docs, corpus, sizes):
    texts = [r["text"] for r in corpus[:60]] + ["the same short text", "the same short text", None, "", " \n\t ", "ÄÖ ÄÖ x\x00y", "one"] * 2
    got = compare(docs(texts), **sizes)
    assert {r[1] for r in got} == {True, False}
    assert {r[0] for r in got if r[1]} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}


def test_the_model_beats_the_base_on_held_out_text(spark):
    rows = [r for r in L.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_sum_to_one():
    weights = L.better_weights(np.abs(np.sin(np.arange(4 * L._SPAN * 4))).reshape(-1, 4), 3)
    assert np.allclose(weights.sum(1), 1) and (weights[L._SPAN : 2 * L._SPAN, 2:] == 0).all()


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    text = "Grüße an  alle\t" * 50 + "x" * 5000 + " " + "y" * 200 + "\n" + " " * 300 + "z" * 3000 + " end"
    words = text.translate(LOWER).split()
    assert [int(h) for p in L.word_hashes(text) for h in p] == [int(h) for w in words for p in L.word_hashes(w) for h in p]
    whole = np.concatenate(list(L.word_hashes(text)))
    assert len(set(words)) == len(set(whole.tolist()))
    for piece in (5000, 4200, 9000):
        monkeypatch.setattr(L, "_PIECE", piece)
        assert (np.concatenate(list(L.word_hashes(text))) == whole).all()
    assert not sum(len(x) for x in L.word_hashes(" \n"))


def test_long_texts_and_single_words(docs):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    compare(docs([long, "a" * 3_000_000, *["some short text"] * 20, long[:5000]]), block_tokens=50_000, range_tokens=100_000)


def test_edges(spark, docs):
    assert L.report(docs([])).count() == 0
    same = docs(["the same words"] * 30).withColumn("doc_id", F.lit(None).cast("long"))
    compare(same)  # one part of the training documents is empty
    texts = docs([f"word{i} and more of the same {i % 3}" for i in range(40)])
    compare(texts.withColumn("doc_id", F.lit(None).cast("long")))  # null ids do not fall together
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = L.report(texts.filter(F.col("doc_id").isin(ids))).collect()  # nothing to learn from
    assert rows and all(r["held_out"] and r["score"] == r["base_score"] == 0 and r["train_tokens"] == 0 for r in rows)
    clash = texts.withColumns({"part": F.lit("x"), "block": F.lit(1), "n": F.lit(2), "row": F.lit(3)})
    assert sorted(map(tuple, L.report(clash).collect())) == sorted(map(tuple, L.report(texts).collect()))
