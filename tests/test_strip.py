from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T


def test_strip_takes_what_the_regular_expression_takes(spark):
    chars = [chr(c) for c in range(0x3100) if c] + ["﻿", "\U0001f600"]
    texts = [f"{c}a {c} b{c}" for c in chars] + [f" \n{c}\t" for c in chars] + ["", "a", " \r\n", "a\n\n", " x\r\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.filter(~T.strip(F.col("t")).eqNullSafe(plain)).count() == 0
    assert "regexp" not in df.select(T.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
