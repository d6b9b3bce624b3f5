"""Languages of a text from character n-gram profiles: a profile a language is counted over labelled texts, each piece of a
text gets a posterior by Bayes' rule over its n-grams, and a text's distribution is the mean of its pieces', by length."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of a profile; characters of a piece; a language below this share is not reported; shorter texts have no languages.
BITS, PIECE, LEAST, SHORTEST = 15, 160, 0.10, 50
SIZE = 1 << BITS
#: A piece's n-grams overlap, so their evidence is taken at this part.
DISCOUNT = 0.3
#: Characters of a text in memory at once.
_BLOCK = 1 << 18


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Buckets of the bigrams and trigrams that begin at each character, block by block: one row a character."""
    whole = " " + text.lower() + "  "
    for at in range(0, len(whole) - 2, _BLOCK):
        cp = np.frombuffer(whole[at : at + _BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        two = (cp[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[: len(cp) - 2]
        three = two * np.uint64(0x165667B19E3779F9) + cp[2:] * np.uint64(0x27D4EB2F165667C5)
        yield np.stack([two >> np.uint64(64 - BITS), three >> np.uint64(64 - BITS)], axis=1).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(SIZE, np.int64))
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for block in _hashes(text.as_py()):
                counts[lang] += np.bincount(block.ravel(), minlength=SIZE)
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], ["lang", "bucket", "n"])


@dataclass
class Profiles:
    """Languages and the logarithm of each n-gram's share in each of them."""

    languages: list[str]
    logs: np.ndarray  # SIZE x languages

    def shares(self, text: str) -> np.ndarray:
        """The posterior of each language, as the mean over the text's pieces."""
        total, seen = np.zeros(len(self.languages)), 0
        for block in _hashes(text):
            evidence = self.logs[block].sum(1)  # a row a character
            starts = np.arange(0, len(evidence), PIECE)
            z = DISCOUNT * np.add.reduceat(evidence, starts, axis=0)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            lengths = np.diff(np.append(starts, len(evidence)))
            total, seen = total + (p * lengths[:, None]).sum(0), seen + len(evidence)
        return total / max(1, seen)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles over all rows with a text and a language. A task sends SIZE counts a language at most."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((SIZE, len(names)))
    if names:
        column = np.searchsorted(np.array(names), np.array(counts.column("lang").to_pylist()))
        table[counts.column("bucket").to_numpy(), column] = counts.column("n").to_numpy()
    return Profiles(names, np.log((table + 0.5) / (table.sum(0) + 0.5 * SIZE)).astype(np.float32))


def distribution(text: Column, profiles: Profiles, least: float = LEAST) -> Column:
    """array<struct<language, probability>>, likeliest first, to 4 places; null below SHORTEST characters, empty without a letter."""

    @F.pandas_udf("array<struct<language:string,probability:double>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict] | None:
            if t is None or len(t.strip()) < SHORTEST:
                return None
            if not profiles.languages or not any(c.isalpha() for c in t):
                return []
            found = [(round(float(p), 4), name) for p, name in zip(profiles.shares(t), profiles.languages, strict=True)]
            return [{"language": name, "probability": p} for p, name in sorted(found, key=lambda x: (-x[0], x[1])) if p >= least]

        return texts.map(one)

    return run(text)
