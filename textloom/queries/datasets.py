"""Queries over data preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import chunking as C
from textloom.operators import datasets as D
from textloom.operators import lexical as L
from textloom.queries.chunks import fixed_sql
from textloom.queries.lexical import bm25_sql, questions, tokens, top_sql
from textloom.registry import query, table


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= CASE lang WHEN 'en' THEN 7 ELSE 4 END AS held_out FROM documents")
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stratified_holdout(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 7}, [F.col("doc_id")], 4)


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) = 1")
def example_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_of(table(spark, sf_dir, "conversations"), ["role", "text"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "role")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY n_chars, doc_id) <= greatest(3, (SELECT count(*) FROM documents) // 10) THEN 'val' ELSE 'train' END AS part FROM documents")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.train_val_split(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "part")


@query("SELECT role, count(*)::BIGINT AS n FROM conversations GROUP BY role")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars / 1000.0::DOUBLE >= 0.25 AND NOT regexp_matches(lower(text), 'doesn''t clearly address|no information') AND regexp_matches(text, '\\[[0-9]+\\]') AS good FROM (SELECT doc_id, n_chars, text || CASE WHEN doc_id % 2 = 0 THEN ' [1]' ELSE '' END AS text FROM documents)")
def example_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("text", F.when(F.col("doc_id") % 2 == 0, " [1]").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", D.good_example(marked, F.col("n_chars") / 1000.0).alias("good"))


@query("SELECT conv_id, turn, '[{\"role\":\"system\",\"content\":\"Answer.\"},{\"role\":\"user\",\"content\":' || to_json(text) || '},{\"role\":\"assistant\",\"content\":\"ok\"}]' AS messages FROM conversations WHERE role = 'user'")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.to_json(D.chat(F.lit("Answer."), F.col("text"), F.lit("ok"))).alias("messages"))


def _cut(n: str, start: str, stop: str) -> str:
    return f"trim(substr(o, ({start}) + 1, ({stop}) - ({start})), ' ' || chr(9) || chr(10) || chr(13))"


def _keys_sql() -> str:
    parts = []
    for k in D.LENGTHS:
        inner = ", ".join([_cut("n", f"n // 2 - {k // 2}", f"n // 2 + {k // 2}"), _cut("n", "n // 4", f"n // 4 + {k}"), _cut("n", f"greatest(3 * n // 4 - {k}, 0)", "3 * n // 4")])
        outer = ", ".join([_cut("n", "80", f"80 + {k}"), _cut("n", f"n - 80 - {k}", "n - 80")])
        parts.append(f"CASE WHEN n <= {k} THEN [o] WHEN n > {k + 80} THEN [{inner}, {outer}] ELSE [{inner}] END")
    return "list_filter(" + " || ".join(parts) + ", lambda x: x <> '')"


@query(
    f"""WITH {fixed_sql(512, 50)}, big AS (SELECT * FROM chunks), {fixed_sql(128, 16).replace('tok AS', 'tok2 AS').replace('FROM tok WHERE', 'FROM tok2 WHERE').replace('st AS', 'st2 AS').replace('FROM st)', 'FROM st2)').replace('chunks AS', 'small AS')},
    q AS (SELECT doc_id || '__' || chunk_index AS query_id, doc_id, trim(text, ' ' || chr(10)) AS o, length(trim(text, ' ' || chr(10))) AS n FROM big),
    k AS (SELECT query_id, doc_id, unnest({_keys_sql()}) AS key, generate_subscripts({_keys_sql()}, 1) AS nth FROM q),
    h AS (SELECT query_id, chunk_index FROM k JOIN small s USING (doc_id) WHERE contains(s.text, k.key) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY nth, chunk_index) = 1)
    SELECT q.query_id, q.doc_id || '__' || h.chunk_index AS chunk_id, CASE WHEN h.chunk_index IS NULL THEN 'no_match' ELSE 'ok' END AS status FROM q LEFT JOIN h USING (query_id)"""
)
def eval_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of every 512-token chunk is looked for in the 128-token chunks of its document."""
    docs = table(spark, sf_dir, "documents")
    name = lambda df: df.withColumn("chunk_id", F.concat_ws("__", "doc_id", "chunk_index")).withColumnRenamed("doc_id", "doc")
    old, new = name(C.chunk_fixed(docs)), name(C.chunk_fixed(docs, size=128, overlap=16))
    asked = old.select(F.col("chunk_id").alias("query_id"), "chunk_id", "doc")
    return D.remap(asked, old.select("chunk_id", "text"), new)


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS known FROM documents d")
def eval_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids of one table exist in another."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("k", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(False)).alias("known"))


@query("SELECT lang AS language, count(*)::BIGINT AS queries, count(DISTINCT source)::BIGINT AS sources FROM documents GROUP BY lang")
def eval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("source").alias("sources"))


@query(
    f"""WITH {bm25_sql('documents')}, h AS ({top_sql(5)}), d AS (SELECT doc_id, text FROM documents)
    SELECT b.item_id AS query_id, count(h.id)::BIGINT AS n_context, coalesce(bool_or(contains(d.text, b.text)), false) AS ground_truth_retrieved FROM benchmark b LEFT JOIN h ON h.query_id = b.item_id LEFT JOIN d ON d.doc_id = h.id GROUP BY b.item_id"""
)
def eval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five documents of each benchmark text, and whether one of them holds the text."""
    docs = table(spark, sf_dir, "documents")
    hits = L.search(L.build_stored(docs, tokens()), questions(spark, sf_dir), tokens(), 5).join(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_doc")), "id")
    asked = questions(spark, sf_dir).withColumnRenamed("text", "asked")
    holding = hits.join(asked, "query_id").filter(F.contains("text", "asked")).groupBy("query_id").agg(F.min("id").alias("answer_chunk_id"))
    out = D.eval_context(asked.join(holding, "query_id", "left"), hits)
    return out.select("query_id", F.size("context_chunks").cast("long").alias("n_context"), "ground_truth_retrieved")
