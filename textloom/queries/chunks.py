"""Queries over chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import chunking as C
from textloom.registry import query, table

STRIP = "' ' || chr(9) || chr(10) || chr(13)"


def fixed_sql(size: int, overlap: int, source: str = "documents") -> str:
    """CTE ``chunks`` of fixed-size chunks."""
    step = size - overlap
    return f"""tok AS (SELECT doc_id, regexp_extract_all(text, '\\s*[^\\s]+') AS t FROM {source}),
    st AS (SELECT doc_id, t, unnest(range(0, greatest(1, len(t) - {overlap}), {step})) AS s FROM tok WHERE len(t) > 0),
    chunks AS (SELECT doc_id, (s // {step})::INT AS chunk_index, s::INT AS start_token, least(s + {size}, len(t))::INT AS end_token, (least(s + {size}, len(t)) - s)::INT AS token_count,
      trim(array_to_string(list_slice(t, s + 1, s + {size}), ''), {STRIP}) AS text FROM st)"""


AT_END = """regexp_matches(text, '([.!?]["'']?|[۔؟！。])$')"""


@query(f"WITH {fixed_sql(C.SIZE, C.OVERLAP)} SELECT doc_id, chunk_index, start_token, end_token, token_count, md5(text) AS text_md5 FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_fixed(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "start_token", "end_token", "token_count", F.md5("text").alias("text_md5"))


@query(
    f"""WITH {fixed_sql(128, 16)} SELECT doc_id, count(*)::BIGINT AS num_chunks, round(avg(token_count), 6) AS mean_tokens, median(token_count)::DOUBLE AS median_tokens,
    round(stddev_pop(token_count), 6) AS std_tokens, round(avg({AT_END}::INT), 3) AS boundary_quality FROM chunks GROUP BY doc_id"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = C.chunk_stats(C.chunk_fixed(table(spark, sf_dir, "documents"), size=128, overlap=16), ["doc_id"])
    return stats.withColumns({"mean_tokens": F.round("mean_tokens", 6), "std_tokens": F.round("std_tokens", 6), "median_tokens": F.col("median_tokens").cast("double")})


def _both(a: str, b: str) -> str:
    return f"WITH {a}, {b}"


@query(
    f"""WITH {fixed_sql(512, 50)}, x AS (SELECT 'fixed_512' AS chunker, doc_id, count(*) AS n, avg(token_count) AS m, round(avg({AT_END}::INT), 3) AS q FROM chunks GROUP BY doc_id),
    {fixed_sql(128, 16).replace('tok AS', 'tok2 AS').replace('FROM tok WHERE', 'FROM tok2 WHERE').replace('st AS', 'st2 AS').replace('FROM st)', 'FROM st2)').replace('chunks AS', 'chunks2 AS')},
    y AS (SELECT 'fixed_128' AS chunker, doc_id, count(*) AS n, avg(token_count) AS m, round(avg({AT_END}::INT), 3) AS q FROM chunks2 GROUP BY doc_id)
    SELECT chunker, count(*)::BIGINT AS docs, sum(n)::BIGINT AS total_chunks, round(avg(m), 6) AS mean_of_means, round(avg(q), 6) AS mean_boundary FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY chunker"""
)
def chunk_strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means of per-document means for two parameter sets."""
    docs = table(spark, sf_dir, "documents")
    each = [C.chunk_fixed(docs, size=s, overlap=o).withColumn("chunker", F.lit(f"fixed_{s}")) for s, o in ((512, 50), (128, 16))]
    stats = C.chunk_stats(each[0].unionByName(each[1]), ["chunker", "doc_id"])
    return stats.groupBy("chunker").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("num_chunks").alias("total_chunks"), F.round(F.avg("mean_tokens"), 6).alias("mean_of_means"), F.round(F.avg("boundary_quality"), 6).alias("mean_boundary")
    )


@query(
    f"""WITH {fixed_sql(128, 16)}, m AS (SELECT doc_id, sum(length(text)) AS chars, max(token_count) AS largest FROM chunks GROUP BY doc_id)
    SELECT doc_id, round(chars / greatest(length(text), 1)::DOUBLE, 4) AS coverage, largest, CASE WHEN largest > 1.1 * 128 THEN 'oversize' WHEN round(chars / greatest(length(text), 1)::DOUBLE, 4) < 0.95 THEN 'low_coverage'
    WHEN round(chars / greatest(length(text), 1)::DOUBLE, 4) > 3.0 THEN 'high_coverage' ELSE 'ok' END AS status FROM documents JOIN m USING (doc_id)"""
)
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return C.verify_chunks(docs, C.chunk_fixed(docs, size=128, overlap=16), size=128)


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_with(table(spark, sf_dir, "documents"), "recursive").select("doc_id", "chunk_index", "start_token", "end_token", "token_count", F.md5("text").alias("text_md5"))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_with(table(spark, sf_dir, "documents"), "semantic").select("doc_id", "chunk_index", "token_count", "overlap_prefix_tokens", F.md5("text").alias("text_md5"))


@query(f"WITH {fixed_sql(512, 50)} SELECT doc_id, count(*)::BIGINT AS num_chunks, round(avg(token_count), 1) AS avg_token_count FROM chunks GROUP BY doc_id")
def chunk_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.chunk_fixed(table(spark, sf_dir, "documents"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_chunks"), F.round(F.avg("token_count"), 1).alias("avg_token_count"))


@query()
def chunk_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of semantic chunks with the stand-in embedder."""
    chunks = C.chunk_with(table(spark, sf_dir, "documents"), "semantic")
    out = C.coherence(chunks)
    return out.select("doc_id", F.round("avg_intra_similarity", 6).alias("intra"), F.round("avg_boundary_similarity", 6).alias("boundary"))
