"""Queries over stored corpora, candidate limits, stage events and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answers as A
from textloom.operators import chunking as C
from textloom.operators import fusion as R
from textloom.operators import metrics as M
from textloom.queries.chunks import fixed_sql
from textloom.queries.dedup import HASH
from textloom.registry import query, table
from textloom.sources import tables
from textloom.streaming import stage_log

_PHRASE = "a of"


@query(f"SELECT doc_id, contains(trim(regexp_replace(text, '[ \\t]+', ' ', 'g')), '{_PHRASE}') AS holds FROM documents")
def phrase_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.holds_phrase(F.col("text"), F.lit(_PHRASE)).alias("holds"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'recursive' WHEN 'fr' THEN 'semantic' WHEN 'ur' THEN 'semantic' WHEN 'ko' THEN 'semantic' WHEN 'ar' THEN 'semantic' ELSE 'recursive' END AS strategy FROM documents")
def strategy_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.strategy_of(F.col("lang")).alias("strategy"))


@query(f"WITH {fixed_sql(C.SIZE, C.OVERLAP)} SELECT source || '/' || doc_id || '.pdf' AS filename, chunk_index, token_count, md5(text) AS text_md5 FROM (SELECT c.*, d.source FROM chunks c JOIN documents d USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels))")
def rechunk_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts of labelled documents in fixed chunks; the metadata knows the files under another suffix."""
    docs = table(spark, sf_dir, "documents")
    meta = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("filename"))
    texts = docs.select(F.concat("doc_id", F.lit(".txt")).alias("filename"), "text")
    return C.rechunk(meta, texts, "fixed").select("filename", "chunk_index", "token_count", F.md5("text").alias("text_md5"))


@query("SELECT lang AS query_id, doc_id AS id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank, source AS source_doc FROM documents QUALIFY rank <= 40")
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = docs.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return R.cap(scored, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_doc")))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metadata that marks copies, and the lines of documents as their chunks."""
    docs = table(spark, sf_dir, "documents")
    firsts = docs.groupBy(T.exact_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("first"))
    meta = docs.select("doc_id", "lang", T.exact_hash(F.col("text")).alias("h")).join(firsts, "h")
    meta = meta.select(F.col("doc_id").cast("string").alias("filename"), (F.col("doc_id") != F.col("first")).alias("is_duplicate"), F.col("lang").alias("primary_language"), F.lit("lines").alias("chunking_strategy_used"))
    lines = docs.select(F.col("doc_id").cast("string").alias("filename"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return meta, lines.withColumn("token_count", F.length("text"))


@query(
    f"""WITH f AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY doc_id) = 1), c AS (SELECT doc_id, lang, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM f)
    SELECT doc_id || '__' || i AS chunk_id, doc_id::VARCHAR AS source_doc, lang AS language, 'lines' AS strategy, length(line)::INT AS token_count, length(trim(line, ' ' || chr(9) || chr(13)))::INT AS chars FROM c WHERE regexp_matches(line, '[^\\s]')"""
)
def corpus_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta, lines = _stored(spark, sf_dir)
    return tables.load_corpus(meta, lines).withColumn("chars", F.length("text")).drop("text")


@query("SELECT doc_id::VARCHAR AS filename, len(string_split(text, chr(10)))::INT AS chunks, length(text)::INT AS chars FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def document_with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta, lines = _stored(spark, sf_dir)
    name = str(table(spark, sf_dir, "documents").agg(F.min("doc_id")).first()[0])
    one = tables.document(meta, lines, name)
    return one.select("filename", F.size("chunks").alias("chunks"), F.length(F.array_join(F.transform("chunks", lambda c: c["text"]), "\n")).alias("chars"))


@query("SELECT source, round(max(n_chars) / 50000.0, 6) AS best, coalesce(max(n_chars) / 50000.0 < 0.5, true) AS research FROM documents GROUP BY source")
def research_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "documents").groupBy("source").agg((F.max("n_chars") / 50000.0).alias("b"))
    return best.select("source", F.round("b", 6).alias("best"), A.needs_research(F.col("b")).alias("research"))


@query(
    """WITH j AS (SELECT source, lang, (n_chars < 1200)::INT AS hit FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)
    SELECT source, round(avg(hit) FILTER (lang = 'de'), 4) AS de, round(avg(hit) FILTER (lang = 'en'), 4) AS en, round(avg(hit) FILTER (lang = 'es'), 4) AS es, round(avg(hit) FILTER (lang = 'fr'), 4) AS fr FROM j GROUP BY source"""
)
def guardrail_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return M.recall_pivot(rows, F.col("toxic") == 1, F.col("n_chars") < 1200, "source", "lang", ["de", "en", "es", "fr"])


@query(
    """WITH f AS (SELECT user_id::VARCHAR AS query_id, event_type AS stage, min(ts) AS t FROM events GROUP BY ALL)
    SELECT query_id, stage, (row_number() OVER w)::INT AS nth, round(coalesce(epoch_us(t) - lag(epoch_us(t)) OVER w, 0) / 1000000.0::DOUBLE, 2) AS elapsed FROM f WINDOW w AS (PARTITION BY query_id ORDER BY t, stage)"""
)
def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the place of questions, event types in the place of stages."""
    events = table(spark, sf_dir, "events")
    reached = events.select(F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("at"))
    return stage_log.stage_events(reached).drop("at")
