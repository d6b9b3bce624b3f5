"""A stored BM25 index: posting blocks with bounds, kept as versions that a reader merges.

Each batch of changed documents becomes one version: posting blocks, the documents with their terms, which earlier documents
it replaces, and by how much term and corpus counts change. A posting counts if no later version replaces its document.
Term and corpus counts are sums over versions; no posting is read for them. ``compact`` folds all versions to one.

A block holds postings of a term that add alike to a score, and the most a posting in it can score is known from the block's
bounds alone. ``search`` uses that: the blocks that promise most give a first list, whose k-th score any
other document must reach; terms that together cannot reach it are not read, nor are blocks that cannot with all the
question's other terms; the documents of the blocks that are read are scored in full, each where its terms are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import lexical as L
from textloom.sources.tables import stored

#: Postings of a block, on average, where a term has that many; postings of the first round, in multiples of k.
BLOCK, FIRST = 256, 8
#: Postings that a task sorts at once.
CHUNK = 1 << 21
#: Ids of blocks or documents that are sent to all tasks; with more of them blocks are joined, and all documents are scored.
LISTED = 1 << 21
#: Version folders are published in this table: a reader sees all of a version or nothing of it.
_PUBLISHED = "version long, base boolean"


def to_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of (id, dl, terms) rows: a task sorts the postings of CHUNK or more at a time by term and by what they add to a
    score, and cuts a term's in blocks of BLOCK. Postings are not shuffled; a block's bounds hold wherever its rows come from."""
    held = f"array<struct<id: {dict(docs.dtypes)['id']}, tf: long, dl: long>>"
    return docs.select("id", "dl", "terms").mapInArrow(_cut(BLOCK), f"term string, cut long, held {held}, most_tf long, least_dl long, n int")


def _cut(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(some: pa.Table, number: int) -> pa.RecordBatch:
        ids, length, terms = (pa.concat_arrays(some[c].chunks) for c in ("id", "dl", "terms"))
        doc = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).fill_null(0).to_numpy())
        pairs = terms.flatten()
        word, tf, dl = pairs.field("term").dictionary_encode(), pairs.field("tf").to_numpy(), length.fill_null(0).to_numpy()[doc]
        code = word.indices.to_numpy()
        order = np.lexsort((-L.impact(tf, dl, dl.mean()), code))
        code, doc, tf, dl = code[order], doc[order], tf[order], dl[order]
        count = np.bincount(code)
        place = np.arange(len(code)) - (np.cumsum(count) - count)[code]  # of a posting among its term's
        start = np.flatnonzero(place % most == 0)
        edges = pa.array(np.append(start, len(code)), pa.int32())
        held = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf), pa.array(dl)], ["id", "tf", "dl"])
        columns = [word.dictionary.take(pa.array(code[start])), pa.array(number + np.arange(len(start))), pa.ListArray.from_arrays(edges, held)]
        bounds = [pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(dl, start)), pc.list_value_length(columns[2])]
        return pa.RecordBatch.from_arrays([*columns, *bounds], ["term", "cut", "held", "most_tf", "least_dl", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in chain((x.slice(at, L._DOCS) for x in batches for at in range(0, x.num_rows, L._DOCS)), [None]):
            if batch is not None:
                waiting.append(batch)
                size += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
            if size and (batch is None or size >= CHUNK):
                out = blocks(pa.Table.from_batches(waiting), number)
                yield out
                number, waiting, size = number + out.num_rows, [], 0

    return run


class PostingStore:
    """Versions of an index under a path. ``tokens`` maps the text column to its terms; ``extras`` names further tables that
    are made from a batch, row by row: each maps (id, text, ...) rows to rows with an ``id``, and is merged by it."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column], id_col: str = "doc_id", text: str = "text", extras: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.path, self.tokens, self.id_col, self.text, self.extras = spark, path.rstrip("/"), tokens, id_col, text, extras or {}

    def versions(self, before: int | None = None) -> list[int]:
        """Published versions from the last base on, in order; ``before`` leaves out that version and later ones."""
        try:
            rows = self.spark.read.schema(_PUBLISHED).parquet(f"{self.path}/published").distinct().collect()  # a row a version
        except Exception as e:  # nothing is published yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        rows = sorted(r for r in rows if before is None or r["version"] < before)
        base = max((r["version"] for r in rows if r["base"]), default=-1)
        return sorted({r["version"] for r in rows if r["version"] >= base})

    def _read(self, name: str, versions: list[int]) -> DataFrame | None:
        found = None
        for v in versions:
            one = self.spark.read.parquet(f"{self.path}/v={v}/{name}").withColumn("version", F.lit(v).cast("long"))
            found = one if found is None else found.unionByName(one)
        return found

    def _write(self, version: int, base: bool, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v={version}/{name}")
        self.spark.createDataFrame([(version, base)], _PUBLISHED).write.mode("append").parquet(f"{self.path}/published")

    def apply(self, batch: DataFrame, version: int, deleted: str | None = None) -> None:
        """Make ``batch`` the version ``version``: its rows replace earlier ones of their ids; ``deleted`` names a flag.

        Of rows with one id the first by a hash of the text stays. Applied again, a version is the same.
        """
        own = batch.select(F.col(self.id_col).alias("id"), "*").filter(F.col("id").isNotNull()) if self.id_col != "id" else batch.filter(F.col("id").isNotNull())
        # only rows whose id comes twice are dealt by id with their texts
        twice = stored(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "twice", f"{self.path}/v={version}/twice")
        first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(self.text)))
        once = own.join(twice, "id", "left_anti").unionByName(own.join(twice, "id", "left_semi").withColumn("_r", first).filter("_r = 1").drop("_r"))
        once = stored(once, "batch", f"{self.path}/v={version}/batch") if self.extras or deleted else once
        kept = once.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else once
        # a document's terms are counted where its text is
        docs = stored(L.counted(kept, self.tokens(F.col(self.text)), "id"), "docs", f"{self.path}/v={version}/docs")
        earlier = self.versions(before=version)
        if not earlier:
            gone, lost = docs.select("id", F.lit(0).cast("long").alias("old"), "dl").limit(0), docs.limit(0)
        else:
            ids = own.select("id") if deleted else docs.select("id")
            gone = self.live(earlier).select("id", F.col("version").alias("old"), "dl").join(ids, "id", "left_semi")
        gone = stored(gone, "gone", f"{self.path}/v={version}/replaced")
        if earlier:
            lost = self._read("docs", earlier).join(gone.select("id", F.col("old").alias("version")), ["id", "version"], "left_semi")
        some = docs.select(F.explode("terms.term").alias("term"))
        lost = lost.select(F.explode("terms.term").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        terms = some.groupBy("term").agg(F.count(F.lit(1)).alias("df")).unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        size = lambda df, sign: df.agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("length"))
        stats = size(docs, 1).unionByName(size(gone, -1)).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        extra = {name: make(kept) for name, make in self.extras.items()}
        self._write(version, False, blocks=to_blocks(docs), gone=gone.select("id", "old"), terms=terms, stats=stats, **extra)

    def live(self, versions: list[int] | None = None) -> DataFrame | None:
        """(id, version, dl, terms) of the documents that no later version replaces."""
        versions = self.versions() if versions is None else versions
        docs = self._read("docs", versions)
        return None if docs is None else self._alive(docs, versions)

    def _alive(self, rows: DataFrame, versions: list[int]) -> DataFrame:
        gone = self._read("gone", versions).select("id", F.col("old").alias("version"))
        return rows.join(gone, ["id", "version"], "left_anti")

    def table(self, name: str) -> DataFrame:
        """An extra table as the live documents have it."""
        versions = self.versions()
        return self._alive(self._read(name, versions), versions).drop("version")

    def lexical(self) -> L.Index:
        """The index's tables as ``lexical.build`` makes them from the live documents at once."""
        versions = self.versions()
        stats = self._read("stats", versions).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).select("n", F.try_divide(F.col("length"), F.col("n")).alias("avgdl"))
        df = self._read("terms", versions).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return L.Index(self.live(versions).select("id", "dl", "terms"), L.weighed(df, stats), stats)

    def compact(self) -> int:
        """Fold all versions to one; readers of earlier versions are not disturbed. Returns the new version."""
        versions = self.versions()
        new = versions[-1] + 1
        index, live = self.lexical(), self.live(versions)
        summed = self._read("stats", versions).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        none = live.select("id", F.col("version").alias("old")).limit(0)
        extra = {name: self.table(name) for name in self.extras}
        self._write(new, True, blocks=to_blocks(live), docs=live.select("id", "dl", "terms"), gone=none, terms=index.terms.select("term", "df"), stats=summed, **extra)
        return new

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply each micro-batch of a stream as a version; one that is replayed replaces itself."""
        return stream.writeStream.foreachBatch(lambda batch, epoch: self.apply(batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def search(self, queries: DataFrame, tokens: Column, k: int, query_id: str = "query_id") -> DataFrame:
        """(query_id, id, score, rank) of the best ``k`` that hold a question's token, as ``lexical.search`` without padding."""
        return self.plan(queries, tokens, k, query_id)["best"]

    def plan(self, queries: DataFrame, tokens: Column, k: int, query_id: str = "query_id") -> dict[str, DataFrame]:
        """The steps of a search: ``asked``, ``met`` (blocks of the questions' terms), ``read`` (those that are read), ``best``."""
        versions = self.versions()
        index = self.lexical()
        stats, live = index.stats.select("avgdl"), self.live(versions)
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        asked = stored(asked.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")), "asked")
        blocks = self._read("blocks", versions)
        name = ["term", "version", "cut"]
        zero = F.lit(0.0)
        promise = F.greatest(F.col("w") * L.impact(F.col("most_tf"), F.col("least_dl"), F.col("avgdl")), zero)
        met = asked.join(blocks.select(*name, "n", "most_tf", "least_dl"), "term").crossJoin(F.broadcast(stats)).select("query_id", *name, "n", promise.alias("bound"))
        met = stored(met, "met")
        per_term = met.groupBy("query_id", "term").agg(F.max("bound").alias("most"))

        avgdl = stats.first()["avgdl"] or 1.0  # one row

        def full(chosen: DataFrame) -> DataFrame:
            """The best scores over all of a question's terms among the documents of some blocks; every document is read once."""
            some = stored(chosen.select("version", "cut").distinct(), "chosen")
            some = F.broadcast(some) if some.count() <= LISTED else some
            ids = stored(blocks.join(some, ["version", "cut"], "left_semi").select(F.explode("held.id").alias("id")).distinct(), "ids")
            docs = live.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= LISTED else live
            return L.candidates(docs, asked, k, lambda tf, dl: L.impact(tf, dl, avgdl))

        # round 1: a question's most promising blocks, until they hold FIRST * k postings
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), *name)
        before = met.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        first = full(before.filter(F.coalesce("before", F.lit(0)) < FIRST * k))
        ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("r") == k)
        least = stored(ranked.select("query_id", (F.col("score") - 1e-5).alias("least")), "least")

        # round 2: what can reach the k-th score of round 1
        low = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        terms = per_term.join(least, "query_id", "left").withColumns({"upto": F.sum("most").over(low), "all": F.sum("most").over(Window.partitionBy("query_id"))})
        needed = terms.filter(F.col("least").isNull() | (F.col("upto") >= F.col("least")))
        read = met.join(needed, ["query_id", "term"]).filter(F.col("least").isNull() | (F.col("bound") + F.col("all") - F.col("most") >= F.col("least")))
        read = stored(read.select("query_id", *name, "most", "all", "least"), "read")
        return {"asked": asked, "met": met, "read": read, "best": L.top(full(read), k)}
