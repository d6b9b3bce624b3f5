"""Quality classifier from weak labels (operator 8).

Heuristic labelers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote patterns
estimates how accurate each labeler is and how probable a good text is under each pattern; these posteriors train a
linear scorer on hashed character n-grams and their spread, which scores every text. The scorer sees the text alone, not the votes.

Scale: patterns are a finite table (3 to the number of labelers), counted per batch and the only thing that is shuffled; the scorer is fitted on a bounded sample: the first ``SAMPLE`` documents by a hash of id and text, with a bounded number of features each; scoring is a map.

Defined results: a null or empty text gets the score 0 and is not kept; null or equal ids leave the sample as large as distinct ones; texts are read whole, in pieces, so a worker
needs a few times the size of its longest text; repeated rows give equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, trim
from textloom.llm.fragments import release
from textloom.llm.grams import SIZE, counted
from textloom.llm.langid import first_by_hash, sample_rows

#: Bound of the fitting sample.
SAMPLE = 4000
EPOCHS = 3
RATE = 0.5
#: A text is kept when the scorer finds it likelier good than bad.
KEEP = 0.5
SCALE = 30.0
EM_ROUNDS = 100
LABELERS = ("length", "word_length", "symbols", "letters", "line_ends", "line_repeats", "capitals", "digits", "word_repeats", "variety")


_LETTER, _CAPITAL, _DIGIT, _SPACE, _SYMBOL = 1, 2, 3, 4, 5
_BLANK = re.compile(f"[{SPACE}]").search
#: Characters of a text that are taken apart at once.
PIECE = 1 << 20
_ENDED = re.compile(rf"[.!?:;\"”»)][{SPACE}]*\Z").search


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each character of the basic plane: letter, capital, digit, ASCII white space, symbol or 0."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        kind = unicodedata.category(chr(cp))
        out[cp] = _CAPITAL if kind == "Lu" else _LETTER if kind[0] == "L" else 0
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[0x30:0x3A] = _DIGIT
    out[[ord(c) for c in "#*$%&|<>{}[]\\^~=_"]] = _SYMBOL
    return out


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut at white space."""
    at = 0
    while len(text) - at > PIECE and (cut := _BLANK(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def votes(text: str) -> str:
    """One character a labeler: + good, - bad, 0 nothing."""
    kinds, n, echoes, last = np.zeros(6, np.int64), 0, 0, None
    different_words: set | np.ndarray = set()
    for at in range(0, len(text), PIECE):
        points = np.minimum(np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
        kinds += np.bincount(_classes()[points], minlength=6)
    for piece in _pieces(text):
        words = [w for w in piece.translate(_BLANKS).split(" ") if w]
        n += len(words)
        echoes += sum(map(eq, words, words[1:])) + bool(words and last == words[0])
        last = words[-1] if words else last
        if len(text) <= PIECE:
            different_words = set(words)
        else:  # of a long text hashes stand for the words
            different_words = np.union1d(np.array(list(different_words), np.int64), np.fromiter(map(hash, words), np.int64, len(words)))
    chars, letters, variety = len(text) - int(kinds[_SPACE]), int(kinds[_LETTER] + kinds[_CAPITAL]), len(different_words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    different, ended = len(set(lines)), sum(1 for x in lines if _ENDED(x[-64:]))

    def vote(good: bool, bad: bool) -> str:
        return "-" if bad else "+" if good else "0"

    return "".join(
        (
            vote(n >= 50, n < 3),
            vote(3 * n <= chars <= 9 * n, chars < 2 * n or chars > 14 * n),
            vote(200 * kinds[_SYMBOL] <= n, 10 * kinds[_SYMBOL] > n),
            vote(10 * letters >= 9 * chars, 10 * letters < 7 * chars),
            vote(10 * ended >= 8 * len(lines), 10 * ended < 3 * len(lines)),
            vote(len(lines) >= 4 and different == len(lines), 10 * different < 7 * len(lines)),
            vote(0 < 20 * kinds[_CAPITAL] <= 3 * letters, chars >= 30 and 10 * kinds[_CAPITAL] > 4 * letters),
            vote(20 * kinds[_DIGIT] <= chars, 5 * kinds[_DIGIT] > chars),
            vote(100 * echoes <= n, 10 * echoes > n),
            vote(10 * variety >= 3 * n, 20 * variety < 3 * n),
        )
    )


_BLANKS = {c: " " for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D)}


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vote patterns and their counts, added up for each batch."""
    release()
    for batch in batches:
        found = Counter(votes(t.as_py() or "") for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["votes", "n"])


def estimate(patterns: list[tuple[str, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """(posterior of good by pattern, accuracy by labeler) by EM over (pattern, count)."""
    if not patterns:
        return {}, dict.fromkeys(LABELERS, 0.5)
    rate = [{1: {"+": 0.7, "0": 0.25, "-": 0.05}, 0: {"+": 0.35, "0": 0.3, "-": 0.35}} for _ in LABELERS]
    prior, soft = 0.8, []
    total = sum(n for _, n in patterns)
    for _ in range(EM_ROUNDS):
        soft = []
        for v, _n in patterns:
            good, bad = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                good, bad = good + math.log(rate[j][1][x]), bad + math.log(rate[j][0][x])
            soft.append(1 / (1 + math.exp(min(60.0, max(-60.0, bad - good)))))
        mass = sum(p * n for p, (_, n) in zip(soft, patterns, strict=True))
        prior = min(0.99, max(0.01, (mass + 8) / (total + 10)))
        for j in range(len(LABELERS)):
            for y, m in ((1, mass), (0, total - mass)):
                # pseudo-counts keep the classes from trading places
                for x, pull in (("+", 7.0 if y else 2.0), ("0", 2.0), ("-", 1.0 if y else 6.0)):
                    hit = sum((p if y else 1 - p) * n for p, (v, n) in zip(soft, patterns, strict=True) if v[j] == x)
                    rate[j][y][x] = (hit + pull) / (m + 10)
    right = {name: (prior * rate[j][1]["+"] + (1 - prior) * rate[j][0]["-"]) / max(1e-9, 1 - prior * rate[j][1]["0"] - (1 - prior) * rate[j][0]["0"]) for j, name in enumerate(LABELERS)}
    return {v: p for p, (v, _) in zip(soft, patterns, strict=True)}, right


def features(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share) of a text with the n-grams ``at`` and their counts, and how its n-grams are spread.

    An n-gram that makes up 2^-k of the text has level k; a level's share of the text is one more feature, hashed with the
    order of magnitude of the text's length, so repetition tells beside what is repeated.
    """
    total = max(1, int(count.sum()))
    level = np.minimum(np.log2(total / np.maximum(count, 1)).astype(np.int64), 15)
    spread = np.bincount(level, weights=count / total, minlength=16)
    return np.concatenate([at, _levels(min(int(total).bit_length(), 20))]), np.concatenate([count / total, spread])


@lru_cache(maxsize=32)
def _levels(magnitude: int) -> np.ndarray:
    return np.array([zlib.crc32(f"level {k} of {magnitude}".encode()) % SIZE for k in range(16)], np.int64)


def fit(samples: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer by AdaGrad on soft labels. samples: (posterior, buckets, shares)."""
    w, n = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            y, at, share = samples[i]
            at, x = np.append(at, SIZE), np.append(SCALE * share.astype(np.float64), 1.0)
            g = x * (1 / (1 + np.exp(-np.clip(x @ w[at], -30, 30))) - y) + 1e-6 * w[at]
            n[at] += g * g
            w[at] -= RATE * g / np.sqrt(n[at])
    return (w[:SIZE] * SCALE).astype(np.float32), float(w[SIZE])


def score(text: str, weights: np.ndarray, bias: float) -> float:
    at, share = features(*counted(text))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(share @ weights[at]) + bias))))


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: weak_label (posterior of its votes), score (of the scorer) and kept."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.dtypes[0][1]
    patterns = rows.select("text").mapInArrow(_vote_rows, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    counts = sorted((r["votes"], r["n"]) for r in patterns.collect())  # at most 3**10 rows
    posterior, _ = estimate(counts)
    if not posterior:
        return rows.select("doc_id", F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            soft = [posterior[votes(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(soft, pa.float64())], ["doc_id", "text", "soft"])

    drawn = first_by_hash(rows.filter(F.length("text") > 0), SAMPLE).mapInArrow(labelled, f"doc_id {kind}, text string, soft double")
    weights, bias = fit([x for x in sample_rows(drawn, F.col("soft"), features) if len(x[1])])
    trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            labels, scores = [], []
            for t in batch.column("text"):
                text_ = t.as_py() or ""
                labels.append(posterior.get(votes(text_), 0.0))
                scores.append(score(text_, weights, bias) if text_ else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "weak_label", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, weak_label double, score double")
    return scored.withColumn("kept", F.col("score") >= KEEP)
