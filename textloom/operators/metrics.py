"""Evaluation metrics: retrieval quality, confusion counts, latencies, answer and judge summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def rank_of(answer: Column, retrieved: Column) -> Column:
    """Place of the answer in the list from 1, null when it is missing."""
    return F.nullif(F.array_position(retrieved, answer), F.lit(0).cast("long"))


def quality(runs: DataFrame, keys: list[str], by: str | None = None, rank: str = "rank", cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Per key, and per key and ``by`` (null in the overall row): n, MRR, recall and precision at each cut, to 4 places."""
    r = F.col(rank)
    measures = [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 4).alias("mrr")]
    for k in cuts:
        hit = F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0)))
        measures += [F.round(hit, 4).alias(f"recall_at_{k}"), F.round(hit / k, 4).alias(f"precision_at_{k}")]
    if by is None:
        return runs.groupBy(*keys).agg(*measures)
    sets = [[F.col(c) for c in keys], [F.col(c) for c in [*keys, by]]]
    return runs.groupingSets(sets, *keys, by).agg(*measures)


def cross_cut(runs: DataFrame, row: str, column: str, values: list[str], rank: str = "rank") -> DataFrame:
    """Recall at 1 by row and column value."""
    return runs.groupBy(row).pivot(column, values).agg(F.round(F.avg(F.coalesce((F.col(rank) <= 1).cast("double"), F.lit(0.0))), 4))


def latency(df: DataFrame, keys: list[str], value: str, digits: int = 3) -> DataFrame:
    """p50, p95 and p99 with linear interpolation, and the median."""
    p = F.percentile(value, F.array(*map(F.lit, (0.5, 0.95, 0.99))))
    out = df.groupBy(*keys).agg(p.alias("p"), F.median(value).alias("median"))
    return out.select(*keys, *[F.round(F.col("p")[i], digits).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.round("median", digits).alias("median"))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def confusion_columns(tp: Column, fn: Column, fp: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1, attack success and false-positive rate; 0 where a denominator is 0."""
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "attack_success": _ratio(fn, tp + fn),
        "false_positive_rate": _ratio(fp, fp + tn),
    }


def confusion(df: DataFrame, expected: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts and rates; with keys one row overall (all keys null) and one for each value of each key."""
    counts = [F.count_if(expected & actual).alias("tp"), F.count_if(expected & ~actual).alias("fn"), F.count_if(~expected & actual).alias("fp"), F.count_if(~expected & ~actual).alias("tn")]
    if keys:
        counted = df.groupingSets([[], *[[F.col(k)] for k in keys]], *keys).agg(*counts)
    else:
        counted = df.agg(*counts)
    return counted.withColumns(confusion_columns(F.col("tp"), F.col("fn"), F.col("fp"), F.col("tn")))


def recall_pivot(df: DataFrame, expected: Column, actual: Column, row: str, column: str, values: list[str]) -> DataFrame:
    """Recall of the expected rows by row and column value, to 4 places; null where nothing was expected."""
    hits = df.filter(expected).select(row, column, actual.cast("double").alias("hit"))
    return hits.groupBy(row).pivot(column, values).agg(F.round(F.avg("hit"), 4))


def threshold_sweep(scored: DataFrame, thresholds: list[float], expected: Column, score: Column) -> DataFrame:
    """Precision, recall, F1 and blocked rows at each threshold, in one pass over the scores."""
    spark = scored.sparkSession
    steps = spark.createDataFrame([(t,) for t in thresholds], "threshold double")
    pairs = scored.select(expected.alias("e"), score.alias("s")).groupBy("e", "s").agg(F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(steps))
    hit = F.col("s") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, F.col("m")).otherwise(0))
    out = pairs.groupBy("threshold").agg(n(F.col("e") & hit).alias("tp"), n(F.col("e") & ~hit).alias("fn"), n(~F.col("e") & hit).alias("fp"))
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return out.select("threshold", (tp + fp).alias("blocked"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def agreement(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Share of the first judge's rows on which the second says the same; a missing verdict disagrees."""
    other = second.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields])
    both = first.join(other, key, "left")
    return both.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce((F.col(f) == F.col(f"_{f}")).cast("double"), F.lit(0.0))), 4).alias(f"{f}_agreement") for f in fields])


def answer_scores(answers: DataFrame, answer: str = "answer", n_context: str = "n_context", truth: str = "truth") -> DataFrame:
    """Per answer: whether and how much it cites, invented numbers, whether it cites the truth (null when not retrieved)."""
    from textloom.functions import text as T

    cites = T.cited(F.col(answer))
    return answers.withColumn("cites", cites).withColumns(
        {
            "has_citations": F.size("cites") > 0,
            "num_citations": F.size("cites"),
            "invented": F.size(F.filter("cites", lambda c: (c < 1) | (c > F.col(n_context)))),
            "cites_truth": F.when(F.col(truth).isNotNull(), F.array_contains("cites", F.col(truth))),
            "answer_length": F.length(answer),
        }
    )


def model_summary(scored: DataFrame, key: str = "model") -> DataFrame:
    """Rates to 3 places and mean latency to 2; truth citation only over answers whose truth was retrieved."""
    rate = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 3).alias(name)
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), rate("has_citations", "citation_rate"), F.round(F.avg((F.col("invented") > 0).cast("double")), 3).alias("invented_rate"), rate("cites_truth", "citation_accuracy"),
        rate("grounded", "grounded_rate"), rate("addresses_query", "addresses_rate"), F.round(F.avg("latency_seconds"), 2).alias("mean_latency"),
    )


def highlights(base: DataFrame, tuned: DataFrame, key: str = "query", n: int = 2) -> DataFrame:
    """The ``n`` answers that improved most: grounded, on topic and not repetitive, with a positive improvement."""
    from textloom.functions import text as T

    b = base.select(F.col(key), F.col("num_citations").alias("b_cites"), F.col("grounded").alias("b_grounded"), F.col("addresses_query").alias("b_topic"))
    both = tuned.filter(F.col("grounded") & F.col("addresses_query") & ~T.repeats(F.col("answer"))).join(b, key)
    gain = F.col("num_citations") - F.col("b_cites") + 2 * (~F.col("b_grounded")).cast("int") + 2 * (~F.col("b_topic")).cast("int")
    ranked = both.withColumn("improvement", gain).filter("improvement > 0")
    return ranked.orderBy(F.desc("improvement"), key).limit(n).select(key, "improvement")


def best_cell(df: DataFrame, what: str, value: str, largest: bool = True) -> DataFrame:
    return df.agg((F.max_by if largest else F.min_by)(what, value).alias(what), (F.max if largest else F.min)(value).alias(value))


def with_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def run_stats(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Per key over queries that every key has: share with marks, share on topic, mean marks (repeats count), mean latency."""
    marks = F.regexp_count(answer, F.lit(r"\[\d+\]"))
    runs = answers.select(*keys).distinct().agg(F.count(F.lit(1)).alias("runs"))
    common = answers.groupBy("query").agg(F.count(F.lit(1)).alias("have")).crossJoin(F.broadcast(runs)).filter("have = runs").select("query")
    return answers.join(common, "query", "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((marks > 0).cast("double")), 6).alias("citation_rate"), F.round(F.avg(F.coalesce(F.col("addresses_query"), F.lit(False)).cast("double")), 6).alias("addresses_rate"),
        F.round(F.avg(marks), 6).alias("mean_citations"), F.round(F.avg("latency_seconds"), 6).alias("mean_latency"),
    )


def expectation_accuracy(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of rows whose actual value equals the expected one, per name; rows without an expectation do not count."""
    return df.agg(*[F.round(F.avg(F.when(F.col(want).isNotNull(), F.col(want).eqNullSafe(F.col(got)).cast("double"))), 4).alias(name) for name, (want, got) in pairs.items()])
