"""Extra columns with clashing names, null ids and repeated rows through every operator."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, jaccard_join, langid, packing, pii, quality_rules, sharding, simhash, token_files, weak_quality

CLASHES = ("_row", "_raw", "_base", "_cand", "base", "spans", "drop", "left", "n_words", "lang_pred", "score", "_letter", "_head", "id", "sig", "fp", "bucket", "tie", "ids", "votes", "part", "h1", "_slice", "content", "host", "line", "n_chars")
BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture
def clashing(docs):
    clean = [f"clean text of number {'abcdefghij'[i % 10]}{'klmnop'[i % 6]} speaks about many different small things and ends here {'qrstuvw'[i % 7]}" for i in range(20)]
    df = docs([*clean, None, "", "mail a.b@c.org or call +1 (555) 010-9999 about " + clean[0]])
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name if name != "n_chars" else 7))
    odd = df.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    odd = odd.withColumn("text", F.lit("words that no other row has stand here in a row of their own without any id"))
    return df.union(df.limit(2)).union(odd)


def test_operators_that_keep_rows(clashing):
    n, columns = clashing.count(), clashing.columns
    for run in (pii.redact, quality_rules.clean, langid.keep_known, jaccard_join.first_of_each):
        out = run(clashing)
        assert out.columns == columns, run
        rows = out.collect()
        assert 0 < len(rows) <= n and all(r["spans"] == "spans" and r["score"] == "score" and r["drop"] == "drop" for r in rows), run
    assert any("[EMAIL]" in (r["text"] or "") for r in pii.redact(clashing).collect())
    assert any(r["doc_id"] is None for r in jaccard_join.first_of_each(clashing).collect())


def test_operators_that_report(clashing):
    n = clashing.count()
    reports = (
        pii.report(clashing),
        jaccard_join.components(clashing),
        langid.report(clashing),
        quality_rules.judge(clashing),
        token_files.report(clashing, WORD_BPE),
        bpe.report(clashing, BPE),
        packing.report(clashing, BPE),
        weak_quality.report(clashing),
        sharding.assign(clashing),
        simhash.report(clashing),
    )
    for out in reports:
        assert out.count() == n, out.columns
