"""The profile of a corpus and its texts of fewest letters, held against their SQL on texts that the given tables lack."""

from __future__ import annotations

import pytest

from textloom import registry

TEXTS = ["", " \n\t", "a" * 41 + "1" * 599, "a  　1", "\x0b\x0b\x0ba", "1a 2b\r\n\f3", None]


@pytest.mark.parametrize("name", ["corpus_profile", "lowest_alpha"])
@pytest.mark.parametrize("some", [TEXTS, TEXTS[2:3], TEXTS[:2] + TEXTS[5:]])
def test_equals_its_sql(spark, tmp_path, name, some):
    import duckdb

    # 57 / 800 = 0.07125 is a tie by its digits, not as a double
    texts = [(some[i % len(some)], "x", int(i < 57)) for i in range(800)]
    rows = [(i, *t) for i, t in enumerate(texts)] + [(800 + i, t, "yz"[i % 2], 3 * i) for i, t in enumerate(some)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(registry.oracle_sql()[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
