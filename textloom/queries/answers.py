"""Queries over answer assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import answers as A
from textloom.registry import derived, plain, query, table

#: A turn as a raw answer: marks of some numbers, and the next turn's sentences as follow-up questions.
RAW = """SELECT conv_id, turn, 1 + turn % 3 AS n, text || ' [' || CAST(turn AS STRING) || '] and [' || CAST(length(text) % 5 AS STRING) || ']' || CASE length(text) % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'FOLLOWUPS:'
    ELSE chr(10) || 'FOLLOWUPS:' || chr(10) || '- ' || replace(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), role), '. ', '?' || chr(10) || chr(10) || '- ') END AS raw FROM {conversations}"""
_RAW_SQL = f"({plain(RAW)})"
_TAIL = "trim(substr(raw, strpos(raw, 'FOLLOWUPS:') + 10), ' ' || chr(10))"


@query(
    f"""SELECT conv_id, turn, CASE WHEN strpos(raw, 'FOLLOWUPS:') > 0 THEN trim(substr(raw, 1, strpos(raw, 'FOLLOWUPS:') - 1), ' ' || chr(10)) ELSE trim(raw, ' ' || chr(10)) END AS answer,
    CASE WHEN strpos(raw, 'FOLLOWUPS:') > 0 THEN array_to_string(list_slice(list_transform(list_filter(string_split({_TAIL}, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(trim(x, '- '))), 1, 3), '|') ELSE '' END AS followups FROM {_RAW_SQL}"""
)
def followup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, RAW).withColumn("p", T.followup_parts(F.col("raw")))
    return df.select("conv_id", "turn", "p.answer", F.array_join("p.followups", "|").alias("followups"))


@query(f"WITH r AS (SELECT conv_id, turn, n, list_sort(list_distinct(list_transform(regexp_extract_all(raw, '\\[([0-9]+)\\]', 1), lambda x: x::INT))) AS c FROM {_RAW_SQL}) SELECT conv_id, turn, array_to_string(list_filter(c, lambda x: x BETWEEN 1 AND n), ',') AS cited FROM r")
def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, RAW)
    chunks = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(F.concat(F.lit("c"), i).alias("chunk_id"), F.lit(None).cast("string").alias("source_doc"), F.lit("t").alias("text"), F.lit(0.9).alias("score")))
    return df.select("conv_id", "turn", F.array_join(F.transform(F.array_sort(F.map_keys(A.cited_sources(F.col("raw"), chunks))), lambda k: k.cast("string")), ",").alias("cited"))


#: A judge's text made of a turn: fields that are missing, spaced or other words than yes and no.
VERDICTS = """SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'GROUNDED: yes' WHEN 1 THEN 'grounded : ' || substr(role, 1, 3) ELSE text END || chr(10) || CASE length(text) % 4 WHEN 0 THEN '' WHEN 1 THEN 'CITED_CORRECTLY: no' ELSE 'cited_correctly:Yes' END || chr(10)
    || CASE turn % 3 WHEN 0 THEN 'ADDRESSES_QUERY: y' WHEN 1 THEN 'ADDRESSES_QUERY  :  maybe' ELSE role END AS raw FROM {conversations}"""


@query(
    f"""WITH v AS (SELECT conv_id, turn, nullif(regexp_extract(raw, '(?i)GROUNDED\\s*:\\s*(\\w+)', 1), '') AS g, nullif(regexp_extract(raw, '(?i)CITED_CORRECTLY\\s*:\\s*(\\w+)', 1), '') AS c, nullif(regexp_extract(raw, '(?i)ADDRESSES_QUERY\\s*:\\s*(\\w+)', 1), '') AS a FROM ({plain(VERDICTS)}))
    SELECT conv_id, turn, starts_with(lower(g), 'y') AS grounded, starts_with(lower(c), 'y') AS cited, starts_with(lower(a), 'y') AS addresses, (g IS NULL AND c IS NULL AND a IS NULL) OR (coalesce(starts_with(lower(g), 'y'), false) AND coalesce(starts_with(lower(c), 'y'), false) AND coalesce(starts_with(lower(a), 'y'), false)) AS passed FROM v"""
)
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived(spark, sf_dir, VERDICTS)
    raw = F.col("raw")
    return df.select("conv_id", "turn", T.verdict_field(raw, "GROUNDED").alias("grounded"), T.verdict_field(raw, "CITED_CORRECTLY").alias("cited"), T.verdict_field(raw, "ADDRESSES_QUERY").alias("addresses"), A.validated(F.lit("draft"), F.lit(1), raw).alias("passed"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id")
def history_last4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.history(table(spark, sf_dir, "conversations"))


_FIRST = "SELECT lang AS query_id, doc_id AS id, n_chars::DOUBLE AS score, 0 AS part FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 5"
_MORE = "SELECT lang AS query_id, doc_id AS id, n_chars + 1::DOUBLE AS score, 1 AS part FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) BETWEEN 3 AND 12"


@query(
    f"""WITH u AS ({_FIRST} UNION ALL {_MORE}), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY part, score DESC) = 1)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, part, id)::INT AS rank FROM o QUALIFY rank <= 10"""
)
def research_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.metrics import with_rank

    ranked = with_rank(table(spark, sf_dir, "documents"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], "r").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), "r")
    first, more = ranked.filter("r <= 5").drop("r"), ranked.filter("r BETWEEN 3 AND 12").select("query_id", "id", (F.col("score") + 1).alias("score"), F.lit(1).alias("part"))
    return A.research_merge(first, more, 5)


#: What the stages of the workflow say, by event.
ROUTES = "SELECT event_id, event_type = 'error' AS bi, value > 20 AS v1, value > 5 AS v2, user_id % 10 = 0 AS bo FROM {events}"


@query(f"SELECT event_id, CASE WHEN bi THEN 'blocked_input' WHEN bo THEN 'blocked_output' WHEN v1 THEN 'answered' WHEN v2 THEN 'retried' ELSE 'hedged' END AS route FROM ({plain(ROUTES)})")
def workflow_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ROUTES).select("event_id", A.route(F.col("bi"), F.col("v1"), F.col("v2"), F.col("bo")).alias("route"))
