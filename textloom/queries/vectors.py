"""Queries over vector search and fusion. Every tenth vector asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import fusion as R
from textloom.operators import lexical as L
from textloom.operators import vectors as V
from textloom.operators.ann import InvertedLists, recall
from textloom.queries import entities as E
from textloom.queries.lexical import bm25_sql, questions, tokens, top_sql
from textloom.registry import query, table
from textloom.sources.tables import stored

_DOT = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def top_vectors_sql(k: int, where: str = "q.vec_id % 10 = 0") -> str:
    return f"""SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 6) DESC, v.vec_id)::INT AS rank
    FROM embeddings q, embeddings v WHERE {where} QUALIFY rank <= {k}"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return V.flat_topk(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), k)


@query(top_vectors_sql(10))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(top_vectors_sql(10).replace(_DOT, "(1 - list_cosine_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))"))
def cosine_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cosine_topk(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, (id = query_id) AS itself FROM ({top_vectors_sql(1)})")
def vector_self_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 1).select("query_id", (F.col("id") == F.col("query_id")).alias("itself"))


@query(
    """SELECT count(*)::BIGINT AS n, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, 0::BIGINT AS with_nan,
    round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS min_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS max_norm,
    0::BIGINT AS extra, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))::BIGINT AS missing FROM embeddings"""
)
def vector_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")).union(table(spark, sf_dir, "embeddings").select("vec_id")).distinct()
    return V.check(table(spark, sf_dir, "embeddings"), both)


_ADJ = """s AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS cosine FROM embeddings)"""


@query(f"WITH {_ADJ} SELECT label, vec_id, round(cosine, 6) AS cosine FROM s WHERE cosine IS NOT NULL")
def adjacent_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.adjacent_cosine(table(spark, sf_dir, "embeddings"), "label", "vec_id").select("label", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_ADJ}, t AS (SELECT * FROM s WHERE cosine IS NOT NULL) SELECT label, vec_id, cosine < avg(cosine) OVER (PARTITION BY label) - stddev_pop(cosine) OVER (PARTITION BY label) AS is_break FROM t")
def semantic_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.adjacent_cosine(table(spark, sf_dir, "embeddings"), "label", "vec_id").select("label", "vec_id", "is_break")


@query(top_vectors_sql(10))
def lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search over inverted lists: lists that cannot hold a better row are not visited."""
    store = V.ListStore()
    store.build(table(spark, sf_dir, "embeddings"))
    return store.search(_asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query()
def lists_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact ten an approximate search finds, for each question; the probes are set on rows of the corpus."""
    vectors = table(spark, sf_dir, "embeddings")
    index = InvertedLists.build(vectors)
    found = index.search(_asked(spark, sf_dir), 10, probes=index.probes_for(10))
    return recall(found, _top(spark, sf_dir, 10))


_SHIFTED = "list_dot_product(list_transform(q.embedding, lambda x: abs(x))::DOUBLE[], list_transform(v.embedding, lambda x: abs(x))::DOUBLE[])"


@query(
    f"""WITH e AS ({top_vectors_sql(5)}), r AS ({top_vectors_sql(5).replace(_DOT, _SHIFTED)})
    SELECT e.query_id, count(r.id)::BIGINT AS shared, round(count(r.id) / count(*)::DOUBLE, 6) AS recall FROM e LEFT JOIN r ON e.query_id = r.query_id AND e.id = r.id GROUP BY e.query_id"""
)
def db_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of a lossy store, which keeps the coordinates' sizes but not their signs, with the exact top five."""
    sizes = lambda df: df.withColumn("embedding", F.transform("embedding", lambda x: F.abs(x)))
    rough = V.flat_topk(sizes(table(spark, sf_dir, "embeddings")), sizes(_asked(spark, sf_dir)), 5)
    return recall(rough, _top(spark, sf_dir, 5))


def _lists(spark: SparkSession, sf_dir: str, k: int = 30) -> tuple[DataFrame, DataFrame]:
    """BM25, and the number of distinct question words in each document's whole text."""
    index = L.build_stored(table(spark, sf_dir, "documents"), tokens())
    lexical = L.search(index, questions(spark, sf_dir), tokens(), k)
    asked = L.asked_terms(questions(spark, sf_dir), tokens()).select("query_id", "term", F.lit(1.0).alias("w"))
    return stored(lexical, "lexical"), stored(L.top(L.candidates(index.docs, asked, k), k), "overlap")


_LISTS = f"""{bm25_sql('documents')}, l1 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM sc QUALIFY rank <= 30),
    li AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
    aq AS (SELECT DISTINCT query_id, term FROM qu), ov AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM aq JOIN li USING (term) GROUP BY ALL),
    l2 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ov QUALIFY rank <= 30),
    rrf AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM l1 UNION ALL SELECT query_id, id, rank FROM l2) GROUP BY ALL)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lists(spark, sf_dir)
    return R.reciprocal_rank(a.select("query_id", "id", "rank").union(b.select("query_id", "id", "rank")))


@query(f"WITH {_LISTS} SELECT query_id, id, round(score, 9) AS score FROM rrf")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"WITH {_LISTS} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INT AS rank FROM rrf QUALIFY rank <= 10")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top(_fused(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_LISTS} SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT query_id, id, score FROM l1 UNION ALL SELECT query_id, id, score FROM l2) GROUP BY ALL")
def variant_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lists(spark, sf_dir)
    return R.merge_variants(a.select("query_id", "id", "score").union(b.select("query_id", "id", "score"))).withColumn("score", F.round("score", 6))


@query(f"WITH {_LISTS} SELECT query_id, id, round(score, 9) AS score FROM rrf QUALIFY score >= 0.5 * max(score) OVER (PARTITION BY query_id)")
def relative_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relative_threshold(_fused(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {_LISTS}, best AS (SELECT query_id, max(score) AS best FROM rrf GROUP BY ALL), g AS (SELECT query_id, id, score / 30 AS score FROM l2)
    SELECT query_id, id, round(max(score), 9) AS score FROM (SELECT * FROM rrf UNION ALL SELECT query_id, id, score * best FROM g JOIN best USING (query_id)) GROUP BY ALL"""
)
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap list in the graph's place: its scores, scaled by the best fused one, join by maximum."""
    a, b = _lists(spark, sf_dir)
    fused = R.reciprocal_rank(a.select("query_id", "id", "rank").union(b.select("query_id", "id", "rank")))
    return R.merge_graph(fused, b.select("query_id", "id", (F.col("score") / 30).alias("score"))).withColumn("score", F.round("score", 9))


_VECTOR_LISTS = f"""{bm25_sql('documents')}, l1 AS (SELECT query_id, id, rank FROM ({top_sql(30)})), l2 AS ({top_vectors_sql(30, 'q.vec_id IN (SELECT item_id FROM benchmark)')}),
    rrf AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM l1 UNION ALL SELECT query_id, id, rank FROM l2) GROUP BY ALL)"""


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 fused with vectors: the vector of a document or question is the one with its id."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    lexical = L.search(L.build_stored(docs, tokens()), questions(spark, sf_dir), tokens(), 30)
    asked = vectors.join(questions(spark, sf_dir).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    near = V.flat_topk(vectors, asked, 30)
    return R.reciprocal_rank(lexical.select("query_id", "id", "rank").union(near.select("query_id", "id", "rank")))


@query(f"WITH {_VECTOR_LISTS} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INT AS rank FROM rrf QUALIFY rank <= 10")
def hybrid_vectors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.top(_with_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_VECTOR_LISTS}, {E.GRAPH_SQL}, gs AS (SELECT query_id, id, score FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10), best AS (SELECT query_id, max(score) AS best FROM rrf GROUP BY ALL)
    SELECT query_id, id, round(max(score), 9) AS score FROM (SELECT query_id, id, score FROM rrf UNION ALL SELECT query_id, id, score * best FROM gs JOIN best USING (query_id)) GROUP BY ALL"""
)
def graph_merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused lists joined by the chunks that the entity graph finds for a question's words."""
    return R.merge_graph(_with_vectors(spark, sf_dir), E.found(spark, sf_dir, 10).select("query_id", "id", "score")).withColumn("score", F.round("score", 9))
