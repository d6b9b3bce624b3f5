"""Helpers that the corpus operators share: column idioms, shared-storage tables, distributed numbering."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"


def trim() -> None:
    """Give memory that this process has freed back to the system, where the C library can (the driver after training)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", "textloom")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """The tables that one run keeps in shared storage; ``clear`` deletes them once the results that read them are written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        for path in self.paths:
            remove(spark, path)
        self.paths.clear()


#: The store of the run in progress; each thread and task of the driver has its own.
_run: ContextVar[Store | None] = ContextVar("run", default=None)


@contextmanager
def store() -> Iterator[Store]:
    """Within the block, what operators store belongs to the store returned."""
    found = Store()
    token = _run.set(found)
    try:
        yield found
    finally:
        _run.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*stored: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads."""
    for df in stored:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def stored_path(spark: SparkSession, label: str) -> str:
    """A new folder in shared storage, part of the run's store if there is one."""
    path = f"{shared_dir(spark)}/textloom-{label}-{uuid.uuid4().hex}"
    if (run := _run.get()) is not None:
        run.paths.append(path)
    return path


#: Whether Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts lineage and survives lost executors.

    Once the table is written nothing needs the shuffle files of its plan, so they are deleted.
    """
    path, conf = stored_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few longs that are sent to every executor at most (about 50 MB).
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows with a hint to broadcast it, if its rows are counted to be few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body`` (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_below(ascending: Column, value: Column) -> Column:
    """How many entries of an ascending array are less than ``value``, by halving."""

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        less = (a["lo"] < a["hi"]) & (F.get(ascending, mid) < value)
        return F.struct(F.when(less, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(less | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(ascending)))), start, halve, lambda a: a["lo"])


def running_max(values: Column, block: int = 256) -> Column:
    """The greatest of the entries up to each place of an array of ints, in blocks instead of from the start each time."""

    def top(xs: Column) -> Column:
        return F.coalesce(F.array_max(xs), F.lit(-(2**31)))

    def of(vs: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / block).cast("int")), lambda b: top(F.slice(vs, b * block + 1, F.lit(block))))

        def whole(ts: Column) -> Column:
            before = F.transform(ts, lambda _t, b: top(F.slice(ts, F.lit(1), b)))
            return let(before, lambda bs: F.transform(vs, lambda _v, i: F.greatest(F.get(bs, F.floor(i / block).cast("int")), top(F.slice(vs, F.floor(i / block).cast("int") * block + 1, i % block + 1)))))

        return let(tops, whole)

    return let(values, lambda vs: F.when(F.size(vs) == 0, F.lit([]).cast("array<int>")).otherwise(of(vs)))


def packed(df: DataFrame, **named: str) -> DataFrame:
    """``df``'s rows as one struct ``_row`` beside the columns an operator works on, so that no extra column can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{source}`").alias(name) for name, source in named.items()])


def unpacked(df: DataFrame, columns: Sequence[str], **changed: Column) -> DataFrame:
    """The columns of ``packed`` rows again, some of them replaced."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in columns])


def words(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space; null and blank give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dense_slots(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, slices: int = 256) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without gaps and without gathering a group in one task.

    Rows are cut into ``slices`` hash slices per group; each slice is numbered on its own and shifted by the
    number of rows in earlier slices (a table of at most groups x slices rows). ``order`` must be unique per
    group for a repeatable result. ``df`` is read twice, so pass a stored table when it is costly.
    """
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    keys = [*group, "_slice"]
    local = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        local.join(starts.drop("_n"), keys)
        .withColumn(name, F.col("_start") + F.col("_rn") - 1)
        .drop("_slice", "_rn", "_start")
    )
