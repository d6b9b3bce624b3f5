"""The answering workflow as branches of DataFrames: guard, retrieve, research, answer, validate, retry once, guard, finish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import providers
from textloom.functions import text as T
from textloom.operators import answers as A
from textloom.operators import guardrails as G
from textloom.plans import retrieval as R
from textloom.sources.tables import stored


def with_chunks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with their hits as an ordered array of (chunk_id, source_doc, text, score)."""
    row = F.struct("rank", F.col("id").alias("chunk_id"), "source_doc", "text", "score")
    packed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_c"))  # at most 2 * top_k hits a question
    chunk = lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["source_doc"].alias("source_doc"), c["text"].alias("text"), c["score"].alias("score"))
    empty = F.array().cast("array<struct<chunk_id:string,source_doc:string,text:string,score:double>>")
    return questions.join(packed, "query_id", "left").withColumn("chunks", F.coalesce(F.transform("_c", chunk), empty)).drop("_c")


def research(corpus: R.Corpus, questions: DataFrame, hits: DataFrame, decompose: Callable[[Column], Column], top_k: int) -> DataFrame:
    """Hits, with those of sub-questions for questions whose best hit is weak."""
    best = questions.select("query_id", "query").join(hits.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
    weak = best.filter(A.needs_research(F.col("best")))
    parts = weak.select("query_id", F.posexplode(T.sub_queries(F.col("query"), decompose(F.col("query")))).alias("part", "sub"))
    subs = parts.select(F.to_json(F.struct("query_id", "part")).alias("query_id"), F.col("sub").alias("query"))
    own = parts.select(F.to_json(F.struct("query_id", "part")).alias("query_id"), F.col("query_id").alias("_q"), F.col("part"))
    found = R.retrieve_raw(corpus, subs, top_k).join(own, "query_id").select(F.col("_q").alias("query_id"), "id", "score", (F.col("part") + 1).alias("part"))
    merged = A.research_merge(hits.join(weak.select("query_id"), "query_id", "left_semi").select("query_id", "id", "score"), found, top_k)
    texts = corpus.chunks.select(F.col("chunk_id").alias("id"), "text", "source_doc")
    strong = hits.join(weak.select("query_id"), "query_id", "left_anti")
    return strong.select("query_id", "id", "score", "rank", "text", "source_doc").unionByName(merged.join(texts, "id").select("query_id", "id", "score", "rank", "text", "source_doc"))


def answer_questions(
    corpus: R.Corpus,
    questions: DataFrame,
    top_k: int = R.TOP_K,
    generate: Callable[[Column, Column], Column] = providers.extractive_answer,
    validate: Callable[[Column, Column], Column] = lambda draft, context: F.lit("GROUNDED: yes\nCITED_CORRECTLY: yes\nADDRESSES_QUERY: yes"),
    decompose: Callable[[Column], Column] = lambda q: F.lit("SINGLE"),
) -> DataFrame:
    """One row a question (query_id, query, language) with answer, sources, confidence, followups and route.

    Blocked questions leave before retrieval. The retry is the second of two unrolled passes; what fails it is hedged.
    """
    checked = G.check_input(questions, text="query")
    passed = checked.filter("NOT blocked").select("query_id", "query", "language")
    # read by the research decision, its merge and the answers
    first_hits = stored(R.retrieve(corpus, passed, top_k), "hits")
    hits = stored(research(corpus, passed, first_hits, decompose, top_k), "hits")
    drafted = A.answer_gate(with_chunks(passed, hits), generate)
    context = A.context_block(F.col("chunks"))
    first = A.validated(F.col("answer"), F.size("chunks"), validate(F.col("answer"), context))
    redrafted = T.followup_parts(generate(F.concat(F.col("query"), F.lit("\nFix the problem of the last draft.")), context))["answer"]
    again = F.when(F.col("confidence") == "low", F.col("answer")).otherwise(redrafted)  # the gate holds for the retry too
    second = A.validated(again, F.size("chunks"), validate(again, context))
    out = drafted.withColumns({"_one": first, "_again": again, "_two": second})
    out = out.withColumn("answer", F.when(F.col("_one"), F.col("answer")).when(F.col("_two"), F.col("_again")).otherwise(A.NOT_SURE))
    out = out.withColumn("confidence", F.when(F.col("_one") | F.col("_two"), F.col("confidence")).otherwise("low"))
    leaks = F.size(G.output_reasons(F.col("answer"), F.col("language"))) > 0
    out = out.withColumn("route", A.route(F.lit(False), F.col("_one"), F.col("_two"), leaks)).withColumn("answer", F.when(leaks, A.REFUSED).otherwise(F.col("answer")))
    done = out.select("query_id", "query", "answer", "sources", "confidence", "followups", "route")
    blocked = checked.filter("blocked").select("query_id", "query", F.lit(A.REFUSED).alias("answer"), F.lit(None).cast(done.schema["sources"].dataType).alias("sources"), F.lit("low").alias("confidence"), F.array().cast("array<string>").alias("followups"), F.lit("blocked_input").alias("route"))
    return done.unionByName(blocked)
