"""Inverted lists: a vector store with a trained coarse quantiser.

Centres are found by k-means over a bounded sample; every row of the corpus is filed under its nearest centre, and a list
that is long is cut in blocks. A search scores each question with the centres and visits the nearest lists. With a number of
``probes`` the result is approximate. Without one it is exact: after a first round of lists, a list is visited too if its
centre and radius leave room for a score above the question's k-th best, and no other list can hold a better row.

Short lists share a block. Each question is sent once to a block, not once to a list; the task there finds which of its lists the
question visits and hands on the best of all of them. Neither side goes through the driver; the centres do (``MAX_LISTS`` at most).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.columns import norm
from textloom.operators.lexical import top
from textloom.sources.tables import stored

#: Bounds: centres, rows that they are fitted on, rows of a block, questions that meet a block at once.
MAX_LISTS, SAMPLE, BLOCK_ROWS, BLOCK_QUESTIONS = 4096, 200_000, 1 << 15, 1 << 14
#: Lists that the first round of an exact search visits.
FIRST_PROBES = 4
#: A smaller table is cut in so many blocks too, of LEAST_ROWS or more.
BLOCKS, LEAST_ROWS = 32, 1 << 10
#: Scores in memory at once.
_CELLS = 1 << 22


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def best_of(questions: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(question, places, scores) of the k best rows; equal scores (to 6 places, as in the final rank) go to the earlier row."""
    step = max(1, _CELLS // max(1, len(rows)))
    for at in range(0, len(questions), step):
        exact = questions[at : at + step] @ rows.T
        scores = np.round(exact, 6)
        least = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(scores), -np.inf)
        for i, s in enumerate(scores):
            near = np.flatnonzero(s >= least[i])
            best = near[np.argsort(-s[near], kind="stable")[:k]]
            yield at + i, best, exact[i, best]


def _scored(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("id")
            ids, names = rows.column("id").to_numpy(), asked.column("query_id").to_numpy()
            for i, places, scores in best_of(_matrix(asked.column("q")), _matrix(rows.column("vec")), k):
                out[0].append(np.full(len(places), names[i]))
                out[1].append(ids[places])
                out[2].append(scores)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(out, kinds, strict=True)], ["query_id", "id", "score"])

    return run


def blocked_topk(blocks: DataFrame, asked: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """(query_id, id, score, rank) of questions (query_id, q, list) over the rows (id, vec, list, block) of their lists.

    ``parts`` deals the questions of a list, so that only so many meet a block at once; the rows are read once a part.
    """
    cut = blocks.select("list", "block").distinct().toDF("list", "block")
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).join(cut, "list")
    rows = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else blocks.withColumn("part", F.lit(0))
    keys = ("list", "block", "part")
    rows, dealt = rows.toDF(*rows.columns), dealt.toDF(*dealt.columns)
    met = rows.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_scored(k), "query_id long, id long, score double")
    return top(met, k)


def _visited(k: int, centres: np.ndarray, radii: np.ndarray, first: int, again: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("list")
            ids, vecs, names = rows.column("id").to_numpy(), _matrix(rows.column("vec")), asked.column("query_id").to_numpy()
            lists, start = np.unique(rows.column("list").to_numpy(), return_index=True)
            end = np.append(start[1:], len(ids))
            q, least = _matrix(asked.column("q")), asked.column("least").fill_null(-np.inf).to_numpy()
            step = max(1, _CELLS // max(len(ids), len(centres)))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                near = some @ centres.T
                open_ = np.zeros(near.shape, bool)
                np.put_along_axis(open_, np.argsort(-near, axis=1, kind="stable")[:, :first], True, axis=1)
                if again:
                    open_ = ~open_ & (near + np.sqrt((some**2).sum(1))[:, None] * radii >= least[at : at + step, None] - 1e-6)
                exact = np.full((len(some), len(ids)), -np.inf)
                for x, a, b in zip(lists, start, end, strict=True):
                    who = np.flatnonzero(open_[:, x])
                    if len(who):
                        exact[who, a:b] = some[who] @ vecs[a:b].T
                for i, s in enumerate(np.round(exact, 6)):
                    kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    best = np.flatnonzero((s >= kth) & (s > -np.inf))
                    best = best[np.lexsort((ids[best], -s[best]))[:k]]
                    for held, more in zip(out, (np.full(len(best), names[at + i]), ids[best], exact[i, best]), strict=True):
                        held.append(more)
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["query_id", "id", "score"])

    return run


def parts_of(asked: DataFrame) -> int:
    return max(1, -(-asked.count() // BLOCK_QUESTIONS))


@dataclass
class InvertedLists:
    """rows (id, vec, list, block), the lists' centres and radii, by list, and how many blocks hold them."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    blocks: int = 1

    @classmethod
    def build(cls, corpus: DataFrame, lists: int | None = None, id_col: str = "vec_id", vec: str = "embedding", cosine: bool = False, seed: int = 7, path: str | None = None) -> "InvertedLists":
        """Fit the centres on about SAMPLE rows at most, drawn in each task, and file every row that has a vector."""
        whole = corpus.filter(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
        if cosine:
            whole = whole.withColumn("vec", F.transform("vec", lambda x: x / F.greatest(norm("vec"), F.lit(1e-10))))
        n = whole.count()
        lists = min(MAX_LISTS, lists or max(1, round(n**0.5)), max(1, n))
        if n == 0:
            return cls(whole.select("id", "vec", F.lit(0).alias("list"), F.lit(0).alias("block")), np.zeros((0, 0)), np.zeros(0))
        drawn = whole.sample(SAMPLE / n, seed=seed) if n > SAMPLE else whole
        found = KMeans(k=lists, seed=seed, maxIter=8, featuresCol="v").fit(drawn.select(array_to_vector("vec").alias("v"))) if lists > 1 else None
        centres = np.array(found.clusterCenters()) if found else np.zeros((1, len(whole.select("vec").first()["vec"])))

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squares = (centres**2).sum(1)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("vec"))
                    near = np.concatenate([(squares - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)])
                    far = np.sqrt(((x - centres[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], ["id", "vec", "list", "far"])

        filed = stored(whole.mapInArrow(file, "id long, vec array<double>, list int, far double"), "lists", path)
        facts = filed.groupBy("list").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("list").collect()  # one row a list
        radii, most = np.zeros(len(centres)), min(BLOCK_ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))
        places, blocks, held = [], 0, most
        for r in facts:
            radii[r["list"]] = r["radius"]
            cuts = -(-r["n"] // most)
            if cuts > 1 or held + r["n"] > most:
                blocks, held = blocks + cuts, 0
            held += r["n"]
            places.append((r["list"], blocks - cuts, cuts))
        placed = corpus.sparkSession.createDataFrame(places, "list int, at int, cuts int")
        dealt = filed.join(F.broadcast(placed), "list").select("id", "vec", "list", (F.col("at") + F.pmod(F.xxhash64("id"), "cuts")).cast("int").alias("block"))
        return cls(dealt, centres, radii, blocks)

    def _round(self, asked: DataFrame, k: int, first: int, again: bool) -> DataFrame:
        """(query_id, id, score) of each block's best ``k`` for questions (query_id, q, least): from the ``first`` nearest lists, or
        ``again`` from the others that leave room for ``least``."""
        parts = parts_of(asked)
        dealt = asked.withColumns({"part": F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))})
        rows = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows, dealt = rows.toDF(*rows.columns), dealt.toDF(*dealt.columns)
        met = _visited(k, self.centres, self.radii, first, again)
        return rows.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(met, "query_id long, id long, score double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", vec: str = "embedding", cosine: bool = False) -> DataFrame:
        """(query_id, id, score, rank) by inner product: of ``probes`` lists, or exact without it. Ties go to the smaller id."""
        asked = queries.filter(F.col(vec).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("q"))
        if cosine:
            asked = asked.withColumn("q", F.transform("q", lambda x: x / F.greatest(norm("q"), F.lit(1e-10))))
        if not len(self.centres):
            return asked.selectExpr("query_id", "query_id AS id", "0D AS score", "1 AS rank").limit(0)
        asked, lists = stored(asked, "questions"), probes or FIRST_PROBES
        first = top(self._round(asked.withColumn("least", F.lit(None).cast("double")), k, lists, False), k)
        if probes is not None:
            return first
        first = stored(first, "first")
        reached = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        rest = self._round(asked.join(reached, "query_id", "left"), k, lists, True)
        return top(first.drop("rank").union(rest), k)

    def probes_for(self, k: int, share: float = 0.95, sample: int = 200) -> int:
        """The fewest lists whose visit finds ``share`` of the exact ``k``, measured on ``sample`` rows of the corpus."""
        if not len(self.centres):
            return 1
        asked = stored(self.rows.orderBy(F.xxhash64("id", F.lit(3))).limit(sample).select(F.col("id").alias("query_id"), F.col("vec").alias("embedding")), "probes")
        exact = self.search(asked, k).select("query_id", "id").join(self.rows.select("id", F.col("list").alias("home")), "id")
        centres = self.centres

        def by_nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = np.argsort(-(_matrix(batch.column("embedding")) @ centres.T), axis=1, kind="stable").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(np.repeat(np.arange(len(lists)), len(centres)))), pa.array(lists.ravel())], ["query_id", "list"])

        order = asked.mapInArrow(by_nearness, "query_id long, list int")
        place = order.groupBy("query_id").agg(F.collect_list("list").alias("lists"))  # in the order of the visit, MAX_LISTS at most
        counts = exact.join(place, "query_id").groupBy(F.array_position("lists", F.col("home")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a place
        need, seen = share * sum(r["n"] for r in counts), 0
        for r in sorted(counts):
            seen += r["n"]
            if seen >= need:
                return int(r["p"])
        return len(self.centres)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, shared, recall): how many of each question's exact rows are found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("shared"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
