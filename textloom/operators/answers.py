"""Answer assembly: context, sources, gates, verdicts, and the bounded state machine of the answering workflow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

CONFIDENCE = 0.5
HISTORY = 4
#: Answers given without a model.
NOTHING_FOUND = "Nothing in the corpus is relevant to this question."
NOT_SURE = "The corpus does not clearly answer this question; the closest passages are listed."
REFUSED = "This request cannot be answered."


def context_block(chunks: Column) -> Column:
    """[i] (source: doc) and text of each chunk, blank lines between; the id stands in for a missing source."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (source: "), F.coalesce(c["source_doc"], c["chunk_id"]), F.lit(")\n"), c["text"])), "\n\n")


def source_map(chunks: Column) -> Column:
    """Map from number to chunk_id, source_doc and rerank_score."""
    return F.map_from_entries(F.transform(chunks, lambda c, i: F.struct((i + 1).alias("key"), F.struct(c["chunk_id"].alias("chunk_id"), F.coalesce(c["source_doc"], c["chunk_id"]).alias("source_doc"), c["score"].alias("rerank_score")).alias("value"))))


def cited_sources(answer: Column, chunks: Column) -> Column:
    """The sources that an answer cites; numbers without a source are dropped."""
    return F.map_filter(source_map(chunks), lambda k, _: F.array_contains(T.cited(answer), k))


def history(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """(conv_id, history): the last ``n`` turns as ``role: text`` lines."""
    last = turns.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("_r") <= n)
    line = F.struct(F.col("turn"), F.concat_ws(": ", "role", "text").alias("line"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))


def needs_research(top_score: Column, least: float = CONFIDENCE) -> Column:
    return top_score.isNull() | (top_score < least)


def research_merge(first: DataFrame, more: DataFrame, top_k: int) -> DataFrame:
    """First hits and unseen ones of sub-queries (order ``part``), by score, at most 2 * top_k a query."""
    rows = first.withColumn("part", F.lit(0)).unionByName(more)
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("part", F.desc("score")))).filter("_r = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "part", "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2 * top_k).select("query_id", "id", "score", "rank")


def validated(draft: Column, n_sources: Column, verdict: Column) -> Column:
    """No draft or no sources fails; a verdict without any field passes; else all three must be yes."""
    fields = [T.verdict_field(verdict, f) for f in ("GROUNDED", "CITED_CORRECTLY", "ADDRESSES_QUERY")]
    unparsed = fields[0].isNull() & fields[1].isNull() & fields[2].isNull()
    all_yes = F.coalesce(fields[0], F.lit(False)) & F.coalesce(fields[1], F.lit(False)) & F.coalesce(fields[2], F.lit(False))
    return F.when(F.coalesce(T.strip(draft), F.lit("")) == "", False).when(F.coalesce(n_sources, F.lit(0)) == 0, False).when(unparsed, True).otherwise(all_yes)


def answer_gate(df: DataFrame, generate: Callable[[Column, Column], Column], least: float = CONFIDENCE) -> DataFrame:
    """Rows (query, chunks, ...) with answer, sources, confidence, top_score and followups.

    Without chunks or with a top score below ``least`` the answer is canned and of low confidence; ``generate`` makes a raw
    answer from the question and the context block otherwise.
    """
    chunks, top = F.col("chunks"), F.coalesce(F.try_element_at("chunks", F.lit(1))["score"], F.lit(0.0))
    parts = T.followup_parts(generate(F.col("query"), context_block(chunks)))
    none, unsure = F.size("chunks") == 0, top < least
    out = df.withColumn("top_score", top).withColumn("_p", parts)
    return out.withColumns(
        {
            "answer": F.when(none, NOTHING_FOUND).when(unsure, NOT_SURE).otherwise(F.col("_p.answer")),
            "sources": F.when(none | unsure, source_map(chunks)).otherwise(cited_sources(F.col("_p.answer"), chunks)),
            "confidence": F.when(none | unsure, "low").otherwise("high"),
            "followups": F.when(none | unsure, F.array().cast("array<string>")).otherwise(F.col("_p.followups")),
        }
    ).drop("_p")


def summarise(df: DataFrame, generate: Callable[[Column, Column, Column], Column], least: float = CONFIDENCE) -> DataFrame:
    """Drafts of rows (query, chunks, retry, issues): ``answer_gate`` with the last draft's issues told on a retry only."""
    told = F.when(F.col("retry"), F.col("issues"))
    return answer_gate(df, lambda query, context: generate(query, context, told), least)


def route(blocked_in: Column, valid_first: Column, valid_retry: Column, blocked_out: Column) -> Column:
    """Where a question ends: blocked_input, answered, retried, hedged or blocked_output. The retry loop is unrolled once."""
    end = F.when(valid_first, "answered").when(valid_retry, "retried").otherwise("hedged")
    return F.when(blocked_in, "blocked_input").when(blocked_out, "blocked_output").otherwise(end)
