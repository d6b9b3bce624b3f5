"""A sparse linear scorer on hashed words for the guardrails, fitted by Spark on labelled texts.

The fit has a lasso penalty, so a few words decide. The threshold is chosen by a sweep over a part of the labelled rows that
the fit did not see. The model is a weight a bucket; it becomes a scorer column, so ``guardrails.check_input`` evaluates it in
its own plan."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from textloom.operators import metrics as M
from textloom.sources.tables import stored

SIZE = 1 << 17
STEPS = [x / 20 for x in range(1, 20)]
_WORDS = re.compile(r"\w+").findall


def _buckets(text: str | None) -> list[int]:
    return sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) % SIZE for w in _WORDS((text or "").lower())})


@F.pandas_udf(ArrayType(IntegerType()))
def buckets(texts: pd.Series) -> pd.Series:
    """The distinct buckets of a text's words."""
    return texts.map(_buckets)


@dataclass
class Scorer:
    """Weights by bucket, only those that are not 0."""

    weights: dict[int, float]
    bias: float
    threshold: float = 0.5

    def column(self, text: Column) -> Column:
        """The score of a text from 0 to 1; 0 without a word."""
        weights, bias = self.weights, self.bias

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            def one(t: str | None) -> float:
                found = _buckets(t)
                z = sum(weights.get(b, 0.0) for b in found) + bias
                return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) if found else 0.0

            return texts.map(one)

        return run(text)

    def scorer(self) -> Callable[[Column], Column]:
        """For ``check_input``: the score moved so that its own threshold lies at that of the guardrails."""
        from textloom.operators.guardrails import THRESHOLD

        shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(self.threshold / (1 - self.threshold)))
        return Scorer(self.weights, self.bias + shift, THRESHOLD).column


def fit(labelled: DataFrame, text: str = "text", label: str = "label", held: Column | None = None, penalty: float = 2e-3) -> tuple[Scorer, DataFrame]:
    """(scorer, sweep) from rows with a 0/1 label; ``held`` says which rows choose the threshold, a fifth by a hash by default.

    Both labels weigh the same in all, however many rows they have. The sweep is the table of ``metrics.threshold_sweep`` on
    the held rows; the threshold is the lowest of those with the best F1.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"), (held if held is not None else F.pmod(F.xxhash64(text), F.lit(5)) == 0).alias("held"))
    vector = F.udf(lambda b: Vectors.sparse(SIZE, b, [1.0] * len(b)), VectorUDT())
    shown = stored(rows.filter("NOT held").select("label", vector(buckets("text")).alias("features")), "features")
    counts = {r["label"]: r["n"] for r in shown.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    weight = F.when(F.col("label") == 1, counts.get(0.0, 1) / counts.get(1.0, 1)).otherwise(1.0)
    model = LogisticRegression(maxIter=60, regParam=penalty, elasticNetParam=1.0, weightCol="weight", standardization=False).fit(shown.withColumn("weight", weight))
    values = model.coefficients.toArray()
    found = Scorer({int(i): float(values[i]) for i in np.flatnonzero(values)}, float(model.intercept))
    scored = stored(rows.filter("held").select((F.col("label") == 1).alias("e"), found.column(F.col("text")).alias("s")), "scored")
    sweep = M.threshold_sweep(scored, STEPS, F.col("e"), F.col("s"))
    found.threshold = sweep.orderBy(F.desc("f1"), "threshold").first()["threshold"]
    return found, sweep
