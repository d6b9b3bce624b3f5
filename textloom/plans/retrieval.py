"""Hybrid retrieval for a batch of questions: one set-oriented plan, no loop over questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import providers
from textloom.functions import text as T
from textloom.operators import entities as G
from textloom.operators import fusion as R
from textloom.operators import lexical as L
from textloom.operators import vectors as V
from textloom.sources.tables import stored

PER_RETRIEVER, POOL, TOP_K = 30, 10, 5


@dataclass
class Corpus:
    """The indexes of a corpus (chunk_id, text, source_doc, language)."""

    chunks: DataFrame
    lexical: L.Index
    vectors: DataFrame
    mentions: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, embed: Callable[[Column], Column] | None = None, model: str = "bge-m3") -> "Corpus":
        """Positions give ids to the vector side; they only name rows and carry no order."""
        embed = embed or providers.embedder()
        numbered = chunks.withColumn("vec_id", F.xxhash64("chunk_id"))
        tokens = T.tokens(F.col("text"), F.col("language"))
        mentions = G.mentions(chunks, G.entities(F.col("text"), F.col("language")), "chunk_id")
        return cls(
            chunks,
            L.build(chunks, tokens, "chunk_id"),
            numbered.select("chunk_id", "vec_id", providers.embed_passages(F.col("text"), model, embed).alias("embedding")),
            mentions,
            G.neighbours(mentions),
        )

    def persist(self) -> "Corpus":
        """The index tables in shared storage, for many batches of questions; lost executors do not lose them.

        The edges follow from the mentions and are made when they are read; a search needs none."""
        mentions = stored(self.mentions, "mentions")
        return Corpus(self.chunks, L.kept(self.lexical), stored(self.vectors, "vectors"), mentions, G.neighbours(mentions))


def hybrid(corpus: Corpus, questions: DataFrame, k: int = POOL, embed: Callable[[Column], Column] | None = None, model: str = "bge-m3") -> DataFrame:
    """(query_id, id, score, rank) of the fused BM25 and vector lists of questions (query_id, query)."""
    embed = embed or providers.embedder()
    lexical = L.search(corpus.lexical, questions, T.tokens(F.col("query"), F.lit(None).cast("string")), PER_RETRIEVER)
    numbered = questions.withColumn("_n", F.xxhash64("query_id"))
    asked = numbered.select(F.col("_n"), providers.embed_questions(F.col("query"), model, embed).alias("embedding"))
    near = V.flat_topk(corpus.vectors, asked, PER_RETRIEVER, query_id="_n")
    near = near.join(numbered.select("query_id", F.col("_n")), near["query_id"] == F.col("_n")).drop(near["query_id"]).join(corpus.vectors.select("chunk_id", F.col("vec_id").alias("id")), "id")
    lists = lexical.select("query_id", "id", "rank").union(near.select("query_id", F.col("chunk_id").alias("id"), "rank"))
    return L.top(R.reciprocal_rank(lists), k)


def retrieve(
    corpus: Corpus,
    questions: DataFrame,
    top_k: int = TOP_K,
    rewrite: Callable[[Column], Column] = providers.same,
    variants: Callable[[Column], Column] | None = None,
    rerank: Callable[[Column, Column], Column] = providers.overlap_score,
    embed: Callable[[Column], Column] | None = None,
    use_graph: bool = True,
) -> DataFrame:
    """(query_id, id, score, rank, text, source_doc) of the reranked candidates.

    ``rewrite`` and ``variants`` give the model's raw texts; the guard and the line rules are applied here. Graph scores use
    the question as asked. Candidates: at least half of the best score, at most 40.
    """
    asked = questions.withColumn("_used", T.guarded_rewrite(F.col("query"), rewrite(F.col("query"))))
    lines = T.query_variants(F.col("_used"), variants(F.col("_used"))) if variants else F.array("_used")
    each = asked.select("query_id", F.posexplode(lines).alias("_v", "query")).select(F.struct("query_id", "_v").alias("query_key"), "query")
    named = each.select(F.to_json("query_key").alias("query_id"), F.col("query_key.query_id").alias("_q"), "query")
    pools = hybrid(corpus, named.select("query_id", "query"), POOL, embed).join(named.select("query_id", "_q"), "query_id")
    merged = R.merge_variants(pools.select(F.col("_q").alias("query_id"), "id", "score"))
    if use_graph:
        wanted = questions.select("query_id", F.explode(G.entities(F.col("query"), F.lit(None).cast("string"))).alias("entity"))
        found = G.graph_topk(wanted, corpus.mentions, POOL)
        merged = R.merge_graph(merged, found.select("query_id", "id", "score"))
    pool = R.cap(R.relative_threshold(merged), corpus.chunks.select(F.col("chunk_id").alias("id"), "text", "source_doc"))
    scored = pool.join(questions.select("query_id", "query"), "query_id").withColumn("score", rerank(F.col("query"), F.col("text")))
    return L.top(scored.drop("rank"), top_k).select("query_id", "id", "score", "rank", "text", "source_doc")


def retrieve_raw(corpus: Corpus, questions: DataFrame, top_k: int = TOP_K, rerank: Callable[[Column, Column], Column] = providers.overlap_score) -> DataFrame:
    """Hybrid search and rerank alone, for sub-questions."""
    pool = hybrid(corpus, questions, 2 * top_k).join(corpus.chunks.select(F.col("chunk_id").alias("id"), "text", "source_doc"), "id")
    scored = pool.join(questions.select("query_id", "query"), "query_id").withColumn("score", rerank(F.col("query"), F.col("text")))
    return L.top(scored.drop("rank"), top_k).select("query_id", "id", "score", "rank", "text", "source_doc")
