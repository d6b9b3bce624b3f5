"""Training and evaluation data: hold-outs, filters, splits, chat formatting and remapping of answers to other chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import let
from textloom.sources.tables import stored

HELD = {"en": 7, "ur": 4, "ko": 4}
LEAST_SCORE = 0.25
LENGTHS = (120, 80, 50, 35)


def stratified_holdout(df: DataFrame, group: str, counts: dict[str, int], order: list[Column], default: int = 0) -> DataFrame:
    """``df`` with ``held_out``: the first rows of each group by ``order``, and rows that tie with the last of them.

    The first rows are found with a limit a group, which prunes before the shuffle; their last key is sent to all rows.
    """
    n = F.lit(default)
    for value, k in counts.items():
        n = F.when(F.col(group) == value, k).otherwise(n)
    keyed = df.withColumn("_k", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))
    first = keyed.select(F.col(group).alias("_g"), "_k", n.alias("_n")).withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_k")))
    edges = first.filter(F.col("_r") <= max(default, *counts.values())).filter(F.col("_r") <= F.col("_n")).groupBy("_g").agg(F.max("_k").alias("_edge"))
    return keyed.join(edges, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("held_out", F.coalesce(F.col("_k") <= F.col("_edge"), F.lit(False))).drop("_k", "_g", "_edge")


def good_example(answer: Column, top_score: Column, hedges: tuple[str, ...] = ("doesn't clearly address", "no information")) -> Column:
    return (top_score >= LEAST_SCORE) & ~T.any_of(answer, hedges) & answer.rlike(r"\[\d+\]")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


#: Rows of a range that is settled by sorting.
SPLIT_RANGE = 200_000


def train_val_split(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``part``: the first max(3, n // 10) rows by ``order`` are val, the rest train.

    Rows are dealt to ranges of the order and counted by range; only the range in which the split falls is sorted to find
    the last row of val. Rows of equal order go by a hash of the row, then by their place, so val has its exact size.
    """
    names = df.columns
    keyed = df.withColumn("_k", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)], F.xxhash64(*names).alias("hash"), F.monotonically_increasing_id().alias("place")))
    n = df.count()
    size = min(n, max(3, n // 10))
    ranged = stored(keyed.repartitionByRange(max(1, -(-n // SPLIT_RANGE)), "_k").withColumn("_range", F.spark_partition_id()), "split")
    counts = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.count(F.lit(1))).collect())  # a row a range
    before, at = 0, None
    for number, count in counts:
        if before + count >= size:
            at = number
            break
        before += count
    if at is None:
        return df.withColumn("part", F.lit("val"))
    edge = ranged.filter(F.col("_range") == at).orderBy("_k").limit(size - before).agg(F.max("_k").alias("_edge"))
    val = (F.col("_range") < at) | ((F.col("_range") == at) & (F.col("_k") <= F.col("_edge")))
    return ranged.crossJoin(F.broadcast(edge)).withColumn("part", F.when(val, "val").otherwise("train")).select(*names, "part")


def chat(system: Column, user: Column, answer: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", user), message("assistant", answer))


#: Where search keys are cut, in order of trust (fixed values): quarter of the text, characters from there, how much of the key
#: lies in front of that place, and whether the text must be longer than the key and an overlap zone.
PLACES = ((2, 0, 0.5, False), (1, 0, 0.0, False), (3, 0, 1.0, False), (0, 80, 0.0, True), (4, -80, 1.0, True))
OVERLAP_ZONE = 80


def excerpts(text: Column) -> Column:
    """Search keys of a chunk: for each of LENGTHS one at each of PLACES; a text that is no longer is its own key."""
    n = F.length(text)

    def key(length: int, quarter: int, shift: int, front: float) -> Column:
        head = int(length * front)
        start = F.floor(n * quarter / 4).cast("int") + shift - head
        stop = start + (2 * head if front == 0.5 else length)
        begin = F.greatest(start, F.lit(0))
        return T.strip(F.substring(text, begin + 1, stop - begin))

    def keys(length: int) -> Column:
        cut = [F.when(n > length + OVERLAP_ZONE if room else F.lit(True), key(length, quarter, shift, front)) for quarter, shift, front, room in PLACES]
        return F.when(n <= length, F.array(text)).otherwise(F.array_compact(F.array(*cut)))

    return F.filter(F.concat(*[keys(k) for k in LENGTHS]), lambda k: k != "")


def remap(queries: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(query_id, chunk_id, status) of queries (query_id, chunk_id, doc) whose answer chunk in ``old`` (chunk_id, text) is
    looked for among the document's chunks in ``new`` (doc, chunk_index, chunk_id, text).

    A query meets its document's chunks once, in one row; its keys are tried in order until one is found.
    """
    chunk = F.struct(F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_id").alias("found"), "text")
    chunks = new.groupBy("doc").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    asked = queries.join(old.select("chunk_id", F.col("text").alias("old_text")), "chunk_id", "left").join(chunks, "doc", "left")

    def hit(nth: Column, key: Column) -> Column:
        held = F.slice(F.filter("chunks", lambda c: F.contains(c["text"], key)), 1, 1)
        return F.get(F.transform(held, lambda c: F.struct(nth.alias("nth"), c["chunk_index"].alias("chunk_index"), c["found"].alias("found"))), 0)

    keys = F.transform(let(T.strip(F.col("old_text")), excerpts), lambda k, i: F.struct(i.alias("nth"), k.alias("key")))
    none = F.lit(None).cast(f"struct<nth:int,chunk_index:bigint,found:{dict(new.dtypes)['chunk_id']}>")
    hits = F.aggregate(keys, none, lambda done, k: F.coalesce(done, hit(k["nth"], k["key"])))
    missing = F.when(F.col("old_text").isNull(), "semantic_chunk_missing").when(F.col("chunks").isNull(), "doc_missing")
    rows = asked.select("query_id", hits.alias("hit"), missing.alias("missing"))
    found = F.min("hit").over(Window.partitionBy("query_id"))["found"]
    status = F.coalesce("missing", F.when(F.col("chunk_id").isNull(), "no_match").otherwise("ok"))
    return rows.select("query_id", found.alias("chunk_id"), "missing").select("query_id", "chunk_id", status.alias("status"))


def eval_context(questions: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """Questions (query_id, ..., answer_chunk_id) with their best ``k`` hits as context and whether the answer is among them."""
    row = F.struct("rank", F.col("id").alias("chunk_id"), "text", "source_doc")
    packed = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("context_chunks"))
    ids = F.transform("context_chunks", lambda c: c["chunk_id"])
    return questions.join(packed, "query_id", "left").withColumn("ground_truth_retrieved", F.coalesce(F.array_contains(ids, F.col("answer_chunk_id")), F.lit(False)))
