"""Best-fit-decreasing sharding of indivisible groups (operator 9).

Documents with equal text form a group that is never split. Groups, largest first, enter the shard with the
tightest remaining capacity that still holds them; shards wait in a balanced tree ordered by remaining capacity.
The capacity is the least one (by bisection) for which the groups need no more than the wanted shards, so sizes
come out near equal. A group larger than a fair share gets a shard of its own and the rest share the others.

Scale: the plan is made over size classes (0.5 % wide, a few thousand at most for any corpus), not over groups:
equal-sized items in a row keep entering the same bin until it is full, so a class is placed in a few steps. A
group's place in its class is a distributed rank. Hot groups only count: they are pre-aggregated by text hash, and
the join that brings the shard back is one that adaptive execution can split.

Defined results: a null text has size 1, CRC 0 and is a group apart from the empty text; repeated rows and equal
ids all get slots of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import dense_slots, materialise

#: Size classes to a factor of e.
CLASSES_PER_E = 200


@dataclass
class _Node:
    key: tuple[float, int]
    rank: float
    left: "_Node | None" = None
    right: "_Node | None" = None


@dataclass
class BinTree:
    """A treap of (remaining capacity, bin): add, remove, and the tightest bin that holds a size."""

    root: _Node | None = None
    rng: random.Random = field(default_factory=lambda: random.Random(7))

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank < b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def _split(self, n: _Node | None, key: tuple[float, int]) -> tuple[_Node | None, _Node | None]:
        """Nodes below ``key`` and the others."""
        if n is None:
            return None, None
        if n.key < key:
            n.right, high = self._split(n.right, key)
            return n, high
        low, n.left = self._split(n.left, key)
        return low, n

    def add(self, remaining: float, bin_: int) -> None:
        low, high = self._split(self.root, (remaining, bin_))
        self.root = self._merge(self._merge(low, _Node((remaining, bin_), self.rng.random())), high)

    def take(self, size: float) -> tuple[float, int] | None:
        """Remove and return the bin with the least remaining capacity that is at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        n = high
        while n.left is not None:
            n = n.left
        _, rest = self._split(high, (n.key[0], n.key[1] + 1))
        self.root = self._merge(low, rest)
        return n.key


def best_fit(classes: list[tuple[int, int, float]], bins: list[int], capacity: float) -> list[tuple[int, int, int]] | None:
    """Place (class, count, item size), largest first; (class, upto rank, bin) runs, or None if a bin is lacking."""
    tree, runs = BinTree(), []
    for b in bins:
        tree.add(capacity, b)
    for cls, count, each in classes:
        done = 0
        while done < count:
            found = tree.take(each)
            if found is None:
                return None
            room, b = found
            n = min(count - done, max(1, int(room / each + 1e-9)))
            done += n
            runs.append((cls, done, b))
            tree.add(room - n * each, b)
    return runs


def plan(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, int, int]]:
    """Runs of every class. classes: (class, count, mean size)."""
    left = sorted(([c, n, each] for c, n, each in classes), key=lambda x: -x[2])
    total, bins, runs = sum(n * each for _, n, each in left), list(range(shards)), []
    taken: dict[int, int] = {}
    while left and len(bins) > 1 and left[0][2] >= total / len(bins):
        cls, n, each = left[0]
        taken[cls] = taken.get(cls, 0) + 1
        runs.append((cls, taken[cls], bins.pop(0)))
        total -= each
        left[0][1] -= 1
        if n == 1:
            left.pop(0)
    if not left:
        return runs
    low = max(total / len(bins), left[0][2])
    high, placed = low, None
    while (placed := best_fit([tuple(x) for x in left], bins, high)) is None:
        high *= 1.02
    for _ in range(40):
        mid = (low + high) / 2
        found = best_fit([tuple(x) for x in left], bins, mid)
        low, high, placed = (low, mid, found) if found is not None else (mid, high, placed)
    return runs + [(c, upto + taken.get(c, 0), b) for c, upto, b in placed]


def assign(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot (gapless in a shard) and grown_shard (null under this law)."""
    spark = df.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        df.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(t) + 1).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.col(text)).alias("h1"),
            F.xxhash64(F.lit(1), F.col(text)).alias("h2"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.min("size").alias("each"))
    groups = materialise(groups.withColumn("cls", F.floor(F.log(F.col("bytes").cast("double")) * CLASSES_PER_E).cast("int")), "shard-groups")
    hist = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    runs = plan([(r["cls"], r["n"], r["b"] / r["n"]) for r in hist.collect()], shards)  # at most a few thousand classes
    by_class: dict[int, list[tuple[int, int]]] = {}
    for cls, upto, b in runs:
        by_class.setdefault(cls, []).append((upto, b))
    schema = T.StructType([T.StructField("cls", T.IntegerType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField("upto", T.LongType()), T.StructField("bin", T.IntegerType())])))])
    table = spark.createDataFrame([(c, sorted(v)) for c, v in by_class.items()], schema)
    ranked = dense_slots(groups, ["cls"], ["h1", "h2"], "rank", slices=64)
    # classes are bounded (log of the corpus size x CLASSES_PER_E), so this side always fits in memory
    placed = ranked.join(F.broadcast(table), "cls").select("h1", "h2", F.filter("runs", lambda r: r["upto"] > F.col("rank"))[0]["bin"].alias("shard"))
    joined = materialise(rows.join(placed, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("tie")), "shard-placed")
    slots = dense_slots(joined, ["shard"], ["doc_id", "tie"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
