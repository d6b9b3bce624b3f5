"""Queries over the BM25 tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunking as C
from textloom.operators import dedup as D
from textloom.operators import lexical as L
from textloom.operators.postings import PostingStore
from textloom.queries.chunks import fixed_sql
from textloom.queries.dedup import HASH
from textloom.registry import query, table
from textloom.sources.tables import new_folder

TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def bm25_sql(corpus: str, key: str = "doc_id") -> str:
    """CTEs of the index over a relation with ``key`` and ``text``."""
    return f"""tk AS (SELECT {key} AS id, {TOKENS} AS t FROM {corpus}), le AS (SELECT id, len(t) AS dl FROM tk), stt AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM le),
    po AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tk) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    ra AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stt), me AS (SELECT avg(raw) AS mean FROM ra), te AS (SELECT term, df, CASE WHEN raw < 0 THEN {L.EPSILON} * mean ELSE raw END AS idf FROM ra, me),
    qu AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
    sc AS (SELECT query_id, id, sum(qtf * idf * tf * {L.K1 + 1} / (tf + {L.K1} * ({1 - L.B} + {L.B} * dl / avgdl))) AS score FROM qu JOIN te USING (term) JOIN po USING (term) JOIN le USING (id), stt GROUP BY ALL)"""


def top_sql(k: int) -> str:
    return f"SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INT AS rank FROM sc QUALIFY rank <= {k}"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokens() -> Column:
    return T.tokens_en(F.col("text"))


@query(f"WITH {bm25_sql('documents')} SELECT term, id, tf::BIGINT AS tf FROM po")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build(table(spark, sf_dir, "documents"), tokens()).postings.select("term", "id", "tf")


_IDF_SQL = f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), d AS MATERIALIZED (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term),
    r AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM d)
    SELECT term, df::BIGINT AS df, round(CASE WHEN raw < 0 THEN {L.EPSILON} * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r"""


@query(_IDF_SQL)
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build_stored(table(spark, sf_dir, "documents"), tokens()).terms.withColumn("idf", F.round("idf", 6))


@query(f"WITH {bm25_sql('documents')} {top_sql(10)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = L.build_stored(table(spark, sf_dir, "documents"), tokens())
    return L.search(index, questions(spark, sf_dir), tokens(), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {bm25_sql('documents')} {top_sql(10)}")
def bm25_blocks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same list from stored posting blocks, most of which the search does not read."""
    store = PostingStore(spark, new_folder(spark, "blocks"), T.tokens_en)
    store.apply(table(spark, sf_dir, "documents"), 0)
    return store.search(questions(spark, sf_dir), tokens(), 10).withColumn("score", F.round("score", 6))


@query(_IDF_SQL)
def reindex_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics after four batches: half of the documents with other texts, the other half, then the texts of the
    first half, twice as a stream replays a batch. They are those of an index built at once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    store = PostingStore(spark, new_folder(spark, "deltas"), T.tokens_en)
    even, odd = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0")
    for version, batch in ((0, even.withColumn("text", F.concat_ws(" ", "source", "text", "source"))), (1, odd), (2, even), (2, even)):
        store.apply(batch, version)
    return store.lexical().terms.withColumn("idf", F.round("idf", 6))


@query(
    f"""WITH dd AS (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) = 1), {fixed_sql(512, 50, 'dd')},
    cc AS (SELECT doc_id || '__' || chunk_index AS chunk_id, text FROM chunks), {bm25_sql('cc', 'chunk_id')} {top_sql(5)}"""
)
def bm25_chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.chunk_fixed(D.without_duplicates(table(spark, sf_dir, "documents")))
    corpus = chunks.select(F.concat_ws("__", "doc_id", "chunk_index").alias("chunk_id"), "text")
    index = L.build_stored(corpus, tokens(), "chunk_id")
    return L.search(index, questions(spark, sf_dir), tokens(), 5).withColumn("score", F.round("score", 6))
