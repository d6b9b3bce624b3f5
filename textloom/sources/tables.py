"""Stored tables: metadata upserts, pruning, corpus assembly, index persistence and resumable results. The layout is Parquet."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; without that setting a temporary one, for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", "textloom")
    return f"{root.rstrip('/')}/textloom-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: later steps do not compute it again, lost executors do not lose it."""
    path = path or new_folder(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this run has stored and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def latest(log: DataFrame, key: str = "filename", order: str = "ingest_seq") -> DataFrame:
    """The last row of each key of an append-only log: what an upsert leaves."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def prune(meta: DataFrame, chunks: DataFrame, key: str = "filename") -> DataFrame:
    """Metadata rows that still have chunks."""
    return meta.join(chunks.select(key).distinct(), key, "left_semi")


def load_corpus(meta: DataFrame, chunks: DataFrame, key: str = "filename") -> DataFrame:
    """(chunk_id, text, source_doc, language, strategy, token_count) without duplicates and blank chunks."""
    kept = meta.filter(~F.coalesce(F.col("is_duplicate"), F.lit(False)))
    rows = chunks.join(kept.select(key, "primary_language", "chunking_strategy_used"), key).withColumn("text", T.strip(F.col("text"))).filter("text <> ''")
    return rows.select(F.concat_ws("__", key, "chunk_index").alias("chunk_id"), "text", F.col(key).alias("source_doc"), F.col("primary_language").alias("language"), F.col("chunking_strategy_used").alias("strategy"), "token_count")


def document(meta: DataFrame, chunks: DataFrame, name: str, key: str = "filename") -> DataFrame:
    """One document's metadata with its chunks in order; no row when it has none."""
    own = chunks.filter(F.col(key) == name).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text", "token_count"))).alias("chunks"))
    return meta.filter(F.col(key) == name).join(own, key)


def save_index(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Write all tables of an index under a version, then publish it: readers see all of it or the one before."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{path}/published")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of the newest published version, or None when there is none."""
    try:
        version = spark.read.schema("version int").parquet(f"{path}/published").agg(F.max("version")).first()[0]
    except Exception as e:  # a path that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return None if version is None else {n: spark.read.parquet(f"{path}/v={version}/{n}") for n in names}


def pending(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has no result yet: what a resumed run still has to do."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def sample_by_group(df: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows of each group in a repeatable random order."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def upload_summary(results: DataFrame) -> DataFrame:
    """One row: total, succeeded and failed of per-file results (filename, error)."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def assert_same_size(left: DataFrame, right: DataFrame, what: str) -> None:
    """Raise when two tables that must match row for row differ in size."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{what}: {a} and {b} rows")


def stage_log(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(query_id, stage, nth) events of a workflow's rows whose column ``route`` says where they ended."""
    ended = {"blocked_input": 1}
    n = F.lit(len(stages))
    for route, k in ended.items():
        n = F.when(F.col("route") == route, k).otherwise(n)
    return rows.select("query_id", F.posexplode(F.slice(F.array(*map(F.lit, stages)), F.lit(1), n)).alias("nth", "stage"))
