"""Queries over metrics. Vector search with the label as relevance gives the ranked runs; labels give ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import metrics as M
from textloom.operators import vectors as V
from textloom.queries.vectors import _asked, top_vectors_sql
from textloom.registry import derived, plain, query, table, values_sql

_RUNS = f"""hits AS ({top_vectors_sql(11)}), r AS (SELECT q.vec_id AS query_id, q.label AS language, CASE WHEN q.vec_id % 20 = 0 THEN 'a' ELSE 'b' END AS model,
    (SELECT min(h.rank - 1) FROM hits h JOIN embeddings v ON v.vec_id = h.id WHERE h.query_id = q.vec_id AND h.id <> h.query_id AND v.label = q.label) AS rank FROM embeddings q WHERE q.vec_id % 10 = 0)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, language, model, rank): place of the first neighbour with the query's label among the next ten."""
    vecs = table(spark, sf_dir, "embeddings")
    asked = _asked(spark, sf_dir)
    hits = V.flat_topk(vecs, asked, 11).filter("id <> query_id").join(vecs.select(F.col("vec_id").alias("id"), F.col("label").alias("found")), "id")
    want = asked.select("query_id", F.col("label").alias("language"), F.when(F.col("query_id") % 20 == 0, "a").otherwise("b").alias("model"))
    first = hits.join(want, "query_id").filter("found = language").groupBy("query_id").agg((F.min("rank") - 1).alias("rank"))
    return want.join(first, "query_id", "left")


_MEASURES = "count(*)::BIGINT AS n, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr, " + ", ".join(
    f"round(avg(coalesce((rank <= {k})::INT, 0)), 4) AS recall_at_{k}, round(avg(coalesce((rank <= {k})::INT, 0)) / {k}, 4) AS precision_at_{k}" for k in M.CUTS
)


@query(f"WITH {_RUNS} SELECT model, language, {_MEASURES} FROM r GROUP BY GROUPING SETS ((model), (model, language))")
def ir_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quality(_runs(spark, sf_dir), ["model"], "language")


@query(f"WITH {_RUNS} SELECT language, round(avg(coalesce((rank <= 1)::INT, 0)) FILTER (model = 'a'), 4) AS a, round(avg(coalesce((rank <= 1)::INT, 0)) FILTER (model = 'b'), 4) AS b FROM r GROUP BY language")
def crosscut_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cross_cut(_runs(spark, sf_dir), "language", "model", ["a", "b"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(quantile_cont(value, 0.99), 3) AS p99, round(median(value), 3) AS median FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


_RATES = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1, round(coalesce(fn / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS attack_success, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 4) AS false_positive_rate"""
_COUNTS = "count(*) FILTER (e AND a)::BIGINT AS tp, count(*) FILTER (e AND NOT a)::BIGINT AS fn, count(*) FILTER (NOT e AND a)::BIGINT AS fp, count(*) FILTER (NOT e AND NOT a)::BIGINT AS tn"
_JUDGED = "j AS (SELECT lang, source, toxic = 1 AS e, n_chars < 1200 AS a, n_chars FROM labels JOIN documents USING (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: expected from toxic, actual from a length rule."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("lang", "source", (F.col("toxic") == 1).alias("e"), (F.col("n_chars") < 1200).alias("a"), "n_chars")


@query(f"WITH {_JUDGED}, c AS (SELECT {_COUNTS} FROM j) SELECT *, {_RATES} FROM c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_judged(spark, sf_dir), F.col("e"), F.col("a"))


@query(f"WITH {_JUDGED}, c AS (SELECT lang, source, {_COUNTS} FROM j GROUP BY GROUPING SETS ((), (lang), (source))) SELECT *, {_RATES} FROM c")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_judged(spark, sf_dir), F.col("e"), F.col("a"), ["lang", "source"])


STEPS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    f"""WITH {_JUDGED}, s AS (SELECT threshold, e, 1000 / (1000 + n_chars)::DOUBLE >= threshold AS a FROM j, {values_sql([(s,) for s in STEPS], ['threshold'])}), c AS (SELECT threshold::DOUBLE AS threshold, {_COUNTS} FROM s GROUP BY 1)
    SELECT threshold, (tp + fp)::BIGINT AS blocked, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1 FROM c"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(_judged(spark, sf_dir), STEPS, F.col("e"), F.lit(1000.0) / (1000 + F.col("n_chars")))


@query(
    """SELECT count(*)::BIGINT AS n, round(avg(coalesce((l.quality = s.quality)::INT, 0)), 4) AS quality_agreement, round(avg(coalesce((l.toxic = s.toxic)::INT, 0)), 4) AS toxic_agreement
    FROM labels l LEFT JOIN (SELECT doc_id, (n_chars > 400)::INT AS quality, (n_chars < 900)::INT AS toxic FROM documents WHERE doc_id % 3 <> 0) s USING (doc_id)"""
)
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") > 400).cast("int").alias("quality"), (F.col("n_chars") < 900).cast("int").alias("toxic"))
    return M.agreement(table(spark, sf_dir, "labels"), second, "doc_id", ["quality", "toxic"])


#: The first two answers of each conversation as those of two models to one question, with marks and verdicts of a judge.
ANSWERS = """SELECT CASE WHEN r = 1 THEN 'base' ELSE 'tuned' END AS model, CAST(conv_id AS STRING) AS query,
    CASE length(text) % 4 WHEN 0 THEN text WHEN 1 THEN text || ' [1]' WHEN 2 THEN text || ' [2] and [' || CAST(turn AS STRING) || '] [2]' ELSE text || ' [1] ' || text || ' [3] [5]' END AS answer,
    CAST(3 AS INT) AS n_context, CAST(nullif(length(text) % 5, 0) AS INT) AS truth, length(text) % 3 > 0 AS grounded, length(text) % 7 > 0 AS addresses_query, CAST(length(text) AS DOUBLE) * 0.01 AS latency_seconds
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations} WHERE role = 'assistant') t WHERE r <= 2"""
_SCORED = f"""s AS (SELECT *, list_distinct(list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: x::INT)) AS cites FROM ({plain(ANSWERS)})),
    t AS (SELECT *, len(cites) > 0 AS has_citations, len(cites)::INT AS num_citations, len(list_filter(cites, lambda c: c < 1 OR c > n_context))::INT AS invented, CASE WHEN truth IS NOT NULL THEN list_contains(cites, truth) END AS cites_truth FROM s)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.answer_scores(derived(spark, sf_dir, ANSWERS))


@query(f"WITH {_SCORED} SELECT model, query, has_citations, num_citations, invented, cites_truth, length(answer)::INT AS answer_length FROM t")
def answer_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("model", "query", "has_citations", "num_citations", "invented", "cites_truth", "answer_length")


@query(
    f"""WITH {_SCORED} SELECT model, count(*)::BIGINT AS n, round(avg(has_citations::INT), 3) AS citation_rate, round(avg((invented > 0)::INT), 3) AS invented_rate, round(avg(cites_truth::INT), 3) AS citation_accuracy,
    round(avg(grounded::INT), 3) AS grounded_rate, round(avg(addresses_query::INT), 3) AS addresses_rate, round(avg(latency_seconds)::DOUBLE, 2) AS mean_latency FROM t GROUP BY model"""
)
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.model_summary(_answers(spark, sf_dir))


#: Whether 40 characters come again behind themselves.
_REPEATS = "len(list_filter(range(1, length(t.answer) - 39), lambda i: contains(substr(t.answer, i + 40), substr(t.answer, i, 40)))) > 0"


@query(
    f"""WITH {_SCORED} SELECT t.query, (t.num_citations - b.num_citations + 2 * (NOT b.grounded)::INT + 2 * (NOT b.addresses_query)::INT)::INT AS improvement FROM t JOIN t b ON t.query = b.query AND b.model = 'base'
    WHERE t.model = 'tuned' AND t.grounded AND t.addresses_query AND NOT {_REPEATS} AND improvement > 0 ORDER BY improvement DESC, t.query LIMIT 2"""
)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _answers(spark, sf_dir)
    return M.highlights(scored.filter("model = 'base'"), scored.filter("model = 'tuned'"))


@query("SELECT max_by(lang, r) AS lang, round(max(r), 6) AS r FROM (SELECT lang, avg(n_chars) AS r FROM documents GROUP BY lang)")
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax of a measure over configurations."""
    each = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("r"))
    return M.best_cell(each, "lang", "r").withColumn("r", F.round("r", 6))


@query(
    """SELECT lang, round(avg((quality = 1)::INT) FILTER (source = 'src1'), 4) AS src1, round(avg((quality = 1)::INT) FILTER (source = 'src2'), 4) AS src2, round(avg((quality = 1)::INT) FILTER (source = 'src3'), 4) AS src3
    FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def recall_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.groupBy("lang").pivot("source", ["src1", "src2", "src3"]).agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 4))


_MARKS = "len(regexp_extract_all(answer, '\\[[0-9]+\\]'))"


@query(
    f"""SELECT model, count(*)::BIGINT AS n, round(avg(({_MARKS} > 0)::INT), 6) AS citation_rate, round(avg(addresses_query::INT), 6) AS addresses_rate, round(avg({_MARKS}), 6) AS mean_citations, round(avg(latency_seconds)::DOUBLE, 6) AS mean_latency
    FROM ({plain(ANSWERS)}) a WHERE (SELECT count(DISTINCT model) FROM ({plain(ANSWERS)}) b WHERE b.query = a.query) = 2 GROUP BY model"""
)
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_stats(_answers(spark, sf_dir), ["model"])


#: What was expected of an event and what came of it.
CASES = """SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id % 2 = 0 END AS expect_expand, event_id % 2 = 0 AS expanded, CASE WHEN user_id % 7 > 0 THEN event_type END AS expect_route,
    CASE WHEN event_id % 5 = 0 THEN 'view' WHEN event_id % 11 > 0 THEN event_type END AS route FROM {events}"""


@query(f"SELECT round(avg((expect_expand = expanded)::INT), 4) AS expand_accuracy, round(avg(CASE WHEN expect_route IS NOT NULL THEN coalesce(expect_route = route, false)::INT END), 4) AS route_accuracy FROM ({plain(CASES)})")
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.expectation_accuracy(derived(spark, sf_dir, CASES), {"expand_accuracy": ("expect_expand", "expanded"), "route_accuracy": ("expect_route", "route")})
