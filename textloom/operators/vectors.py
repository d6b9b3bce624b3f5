"""Vector search over all rows and by inverted lists. A few questions travel with the plan, many meet the corpus in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import dot, norm
from textloom.operators.ann import BLOCK_ROWS, InvertedLists, _matrix, best_of, blocked_topk, parts_of
from textloom.operators.lexical import top

#: Up to so many question vectors are sent to the corpus with the plan; more of them meet it in blocks, by a shuffle.
BLOCK = 4096


def _scored_batches(matrix: np.ndarray, ids: np.ndarray, k: int):
    """Local top k of each query per Arrow batch: a task never emits more than queries x k rows a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by("id")  # ties to the smaller id
            own, corpus = batch.column("id").to_numpy(), _matrix(batch.column("vec"))
            for i, places, scores in best_of(matrix, corpus, k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), ids[i])), pa.array(own[places]), pa.array(scores)], ["query_id", "id", "score"])

    return run


def flat_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank) by inner product, ties by id. Rows without a vector match nothing.

    Each task returns at most k rows a query and batch. BLOCK questions at most come to the driver; a larger set is dealt in
    parts that meet blocks of the corpus in tasks.
    """
    rows = corpus.filter(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    asked = queries.filter(F.col(vec).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("q"))
    few = asked.limit(BLOCK + 1).toArrow()
    if few.num_rows > BLOCK:
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        dealt = rows.withColumns({"list": F.lit(0), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")})
        return blocked_topk(dealt, asked.withColumn("list", F.lit(0)), k, parts_of(asked))
    if not few.num_rows:
        return rows.selectExpr("id AS query_id", "id", "0D AS score", "1 AS rank").limit(0)
    matrix, names = _matrix(few.column("q")), few.column("query_id").to_numpy()
    return top(rows.mapInArrow(_scored_batches(matrix, names, k), "query_id long, id long, score double"), k)


def pair_scores(corpus: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """The same scores by column expressions only: a stated query set against all rows."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vec).alias("q"))
    return corpus.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).crossJoin(F.broadcast(asked)).select("query_id", "id", dot("q", "v").alias("score"))


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """Similarity 1 - cosine distance, for vectors of any length; zero vectors have similarity 0."""
    unit = lambda df: df.withColumn(vec, F.transform(vec, lambda x: x / F.greatest(norm(vec), F.lit(1e-10))))
    return flat_topk(unit(corpus), unit(queries), k, id_col, vec, query_id)


def check(embeddings: DataFrame, corpus_ids: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row: count, dimensions, NaN vectors, norms, and ids missing on either side."""
    facts = embeddings.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(vec)).alias("min_dim"),
        F.max(F.size(vec)).alias("max_dim"),
        F.count_if(F.exists(vec, lambda x: F.isnan(x))).alias("with_nan"),
        F.round(F.min(norm(vec)), 4).alias("min_norm"),
        F.round(F.max(norm(vec)), 4).alias("max_norm"),
    )
    sides = embeddings.select(F.col(id_col).alias("id"), F.lit(1).alias("e")).join(corpus_ids.select(F.col(id_col).alias("id"), F.lit(1).alias("c")), "id", "full")
    return facts.crossJoin(sides.agg(F.count_if(F.col("c").isNull()).alias("extra"), F.count_if(F.col("e").isNull()).alias("missing")))


def adjacent_cosine(vectors: DataFrame, group: str, order: str, vec: str = "embedding") -> DataFrame:
    """Each row's cosine with the row before it in its group, and whether a break stands there (below mean - std)."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.lag(vec).over(w)
    sims = vectors.select(group, order, (dot(F.col(vec), before) / (F.greatest(norm(F.col(vec)), F.lit(1e-10)) * F.greatest(norm(before), F.lit(1e-10)))).alias("cosine")).filter("cosine IS NOT NULL")
    whole = Window.partitionBy(group)
    return sims.withColumn("is_break", F.col("cosine") < F.avg("cosine").over(whole) - F.stddev_pop("cosine").over(whole))


class VectorStore:
    """build / search / teardown over DataFrames; scores are higher for more similar rows."""

    def __init__(self, id_col: str = "vec_id", vec: str = "embedding"):
        self.id_col, self.vec, self.corpus = id_col, vec, None

    def build(self, corpus: DataFrame) -> None:
        self.corpus = corpus

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if self.corpus is None:
            raise RuntimeError("the store is not built")
        return flat_topk(self.corpus, queries, k, self.id_col, self.vec)

    def teardown(self) -> None:
        self.corpus = None


class CosineStore(VectorStore):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return cosine_topk(self.corpus, queries, k, self.id_col, self.vec)


class ListStore(VectorStore):
    """A store on inverted lists: approximate with ``probes``, exact without."""

    def __init__(self, id_col: str = "vec_id", vec: str = "embedding", lists: int | None = None, probes: int | None = None, cosine: bool = False):
        super().__init__(id_col, vec)
        self.lists, self.probes, self.cosine = lists, probes, cosine

    def build(self, corpus: DataFrame) -> None:
        self.corpus = InvertedLists.build(corpus, self.lists, self.id_col, self.vec, self.cosine)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if self.corpus is None:
            raise RuntimeError("the store is not built")
        return self.corpus.search(queries, k, self.probes, vec=self.vec, cosine=self.cosine)
