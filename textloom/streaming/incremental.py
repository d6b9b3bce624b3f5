"""Index maintenance from a stream of documents, and event-time windows over the driver's event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import lexical as L
from textloom.sources.tables import pending


def reindex_partial(corpus: DataFrame, indexed: DataFrame, embed: Callable[[Column], Column], id_col: str = "chunk_id") -> tuple[DataFrame, int]:
    """(vectors of chunks that are not indexed yet, their number). Deleted and edited chunks are not looked for."""
    new = pending(corpus, indexed, [id_col])
    return new.select(id_col, embed(F.col("text")).alias("embedding")), new.count()


def changed(corpus: DataFrame, indexed: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Optional beyond the partial reindex: ids whose text hash (column ``hash`` of ``indexed``) differs, or that are gone."""
    now = corpus.select(id_col, F.sha2("text", 256).alias("_now"))
    both = now.join(indexed.select(id_col, "hash"), id_col, "full")
    return both.filter(F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_now"))).select(id_col, F.when(F.col("_now").isNull(), "deleted").otherwise("edited").alias("change"))


def follow_postings(stream: DataFrame, tokens: Column, path: str, checkpoint: str, id_col: str = "doc_id") -> StreamingQuery:
    """Append each micro-batch's postings to a table; a replayed batch overwrites its own folder, so nothing counts twice.

    For batches that replace documents see ``operators.postings.PostingStore``, which keeps all statistics up to date.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        L.build(batch, tokens, id_col).postings.select("term", "id", "tf").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events per window and type; ``ts`` without a zone is read as UTC. Works on tables and streams."""
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if zoned.isStreaming:
        zoned = zoned.withWatermark("ts", late)
    grouped = zoned.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
