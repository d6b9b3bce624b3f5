"""Language identification (operator 3): sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) and the scores are
calibrated by one temperature on a part of the sample that training did not see. Document frequencies cover every
training document; the classifier is fitted on a bounded sample of them: the first documents by a hash of id and text,
``PER_LANGUAGE`` a language at most and ``IN_ALL`` in all at most (but one a language), each with its ``FEATURES`` most frequent
n-grams. Training documents are those with a language whose CRC-32 of the id, modulo 3, is not 1; a null id is one.

Scale: document frequencies are summed per task (at most 2**16 rows each) before they are shuffled; scoring is a map
over Arrow batches with a model of 2**16 weights a language. Nothing else moves.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when nothing can be
learned; null or equal ids leave the sample as large as distinct ones; ties go to the first language in order; texts are read whole, n-grams in blocks, so a worker needs a few times
the size of its longest text; repeated rows give equal results;
extra columns are ignored by ``report`` and kept by ``keep_known``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import packed, trim, unpacked
from textloom.llm.fragments import release
from textloom.llm.grams import SIZE, counted, grams, mean_weight

#: Bounds of the fitting sample: documents a language, documents in all, and n-grams of a document.
PER_LANGUAGE, IN_ALL, FEATURES = 800, 8000, 4096
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-3
#: Relative frequencies are small; this brings a text's features near unit size.
SCALE = 30.0
#: Share of the sample that sets the temperature.
HELD_SHARE = 0.2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SIZE x languages, IDF and scale included
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        return mean_weight(self.weights, text) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed form of FTRL-proximal's weights under elastic-net penalties."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray, languages: list[str]) -> Model:
    """samples: (language index, buckets, counts or shares)."""
    k = len(languages)
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))  # the last row is the bias
    rng = np.random.default_rng(11)
    order = rng.permutation(len(samples))
    cut = int(len(samples) * HELD_SHARE) if len(samples) >= 20 else 0
    held, used = order[:cut], order[cut:]

    def features(i: int) -> tuple[np.ndarray, np.ndarray]:
        at, count = samples[i][1], samples[i][2].astype(np.float64)
        return np.append(at, SIZE), np.append(SCALE * count / count.sum() * idf[at], 1.0)

    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            at, x = features(i)
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            p = softmax(x @ w)
            p[samples[i][0]] -= 1.0
            g = x[:, None] * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = _weights(z, n)
    model = Model(languages, (w[:SIZE] * (SCALE * idf)[:, None]).astype(np.float32), w[SIZE])
    if cut:
        logits = np.array([x @ w[at] for at, x in map(features, held)])
        gold = np.array([samples[i][0] for i in held])

        def loss(t: float) -> float:
            return float(-np.log(softmax(logits / t)[np.arange(len(gold)), gold] + 1e-12).mean())

        low, high = np.log(0.02), np.log(20.0)
        for _ in range(60):  # golden section over the logarithm
            a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
            low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    total, docs = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for t in batch.column("text"):
            seen = np.zeros(SIZE, bool)
            for block in grams(t.as_py() or ""):
                seen[block] = True
            total += seen
            docs += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], docs))], ["bucket", "docs"])


Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def shares(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at, count / max(1, count.sum())


def _feature_rows(features: Features) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(text: str) -> tuple[np.ndarray, np.ndarray]:
        at, value = features(*counted(text))
        if len(at) > FEATURES:  # the largest, ties to the smaller bucket
            most = np.sort(np.lexsort((at, -value))[:FEATURES])
            at, value = at[most], value[most]
        return at, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *columns], ["label", "at", "value"])

    return run


def first_by_hash(df: DataFrame, bound: int, group: str | None = None) -> DataFrame:
    """``bound`` rows at most (of each value of ``group``), the first by a hash of doc_id and text; all rows if there are fewer.

    The hashes alone are ranked to find where to cut, so that texts are only sorted near the bound.
    """
    marked = df.withColumn("_hash", F.xxhash64("doc_id", "text", F.lit(17)))
    keys = [group] if group else []
    first = Window.partitionBy(*keys).orderBy("_hash") if group else None
    narrow = marked.select("_hash", *keys)
    narrow = narrow.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= bound) if group else narrow.orderBy("_hash").limit(bound)
    cuts = narrow.groupBy(*keys).agg(F.max("_hash").alias("cut")).collect()  # one row a group
    below = F.lit(False)
    for r in cuts:
        if r["cut"] is not None:
            below = below | ((F.col(group) == r[group]) & (F.col("_hash") <= r["cut"]) if group else F.col("_hash") <= r["cut"])
    near = marked.filter(below)
    near = near.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= bound) if group else near.orderBy("_hash").limit(bound)
    return near.select(*df.columns)


def sample_rows(drawn: DataFrame, label: Column, features: Features) -> list[tuple]:
    """(label, buckets, values) of the rows drawn: FEATURES pairs a row at most."""
    rows = drawn.select(label.alias("label"), "text").mapInArrow(_feature_rows(features), f"label {drawn.select(label).dtypes[0][1]}, at array<int>, value array<float>")
    table = rows.toArrow()
    pairs = zip(table.column("label").to_pylist(), table.column("at"), table.column("value"), strict=True)
    out = [(y, a.values.to_numpy(), v.values.to_numpy()) for y, a, v in pairs]
    return sorted(out, key=lambda x: (str(x[0]), len(x[1]), x[1].tobytes(), x[2].tobytes()))  # the same order on any cluster


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return None
    languages = sorted(counts)
    spread = rows.select("text").mapInArrow(_document_counts, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    table = spread.toArrow()  # at most 2**16 + 1 rows
    seen = dict(zip(table.column("bucket").to_pylist(), table.column("docs").to_pylist(), strict=True))
    total = seen.pop(-1, 0)
    frequency = np.zeros(SIZE)
    frequency[np.fromiter(seen.keys(), np.int64, len(seen))] = np.fromiter(seen.values(), np.float64, len(seen))
    idf = np.log((1 + total) / (1 + frequency)) + 1
    drawn = first_by_hash(rows, max(1, min(PER_LANGUAGE, IN_ALL // len(languages))), "lang")
    samples = [(languages.index(y), at, v) for y, at, v in sample_rows(drawn, F.col("lang"), shares) if len(at)]
    model = fit(samples, idf, languages) if samples else None
    del samples, seen, table
    trim()
    return model


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score, in place of columns of these names."""
    df = df.drop("lang_pred", "score", "_letter")
    marked = df.withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            said = [model.predict(t.as_py()) if ok.as_py() and model else ("und", 0.0) for t, ok in zip(batch.column(text), batch.column("_letter"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], [*names, "lang_pred", "score"])

    schema = type(df.schema)([*df.schema.fields])
    schema = schema.add("lang_pred", "string").add("score", "double")
    return marked.mapInArrow(run, schema)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: held_out, lang_pred and score."""
    model = train(df, doc_id, text, lang)
    rows = df.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(df: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text is in a learned language with at least the score ``least``; all columns stay."""
    found = predict(packed(df, text=text), train(df, doc_id, text, lang))
    return unpacked(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)), df.columns)
