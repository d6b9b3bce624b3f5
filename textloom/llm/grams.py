"""Hashed character n-grams of a text as numpy arrays; shared by the linear models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 16
SIZE = 1 << BITS


#: Characters of a text whose n-grams are in memory at once.
BLOCK = 1 << 18


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all character bigrams and trigrams of the lower-cased text, with repeats, block by block."""
    padded = f" {text.lower()} "
    for at in range(0, len(padded) - 1, BLOCK):
        cp = np.frombuffer(padded[at : at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        a, b = cp * np.uint32(0x9E3779B1), cp * np.uint32(0x85EBCA6B)
        two = a[:-1] ^ (b[1:] + np.uint32(0x27D4EB2F))
        two ^= two >> np.uint32(15)
        two *= np.uint32(0x2C1B3C6D)
        three = two[:-1] ^ (cp[2:] * np.uint32(0xC2B2AE35))
        three ^= three >> np.uint32(13)
        three *= np.uint32(0x297A2D39)
        yield np.concatenate([two[:BLOCK], three]) >> np.uint32(32 - BITS)


def mean_weight(weights: np.ndarray, text: str) -> np.ndarray:
    """The mean of the n-grams' weights."""
    total, n = 0.0, 0
    for block in grams(text):
        total, n = total + weights[block].sum(0, dtype=np.float64), n + len(block)
    return total / n


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the n-grams of a text."""
    found = sum(np.bincount(block, minlength=SIZE) for block in grams(text))
    at = np.flatnonzero(found)
    return at, found[at]
