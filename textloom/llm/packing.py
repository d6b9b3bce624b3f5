"""Packing by optimal length buckets (operator 7).

Texts are counted in tokens (an end token included) and cut into pieces of at most ``MAX_TOKENS``. Dynamic programming
over the histogram of all piece lengths chooses the bucket lengths that need the least padding; inside each bucket
consecutive pieces form batches of as many as a token budget holds at the bucket's length. Every piece comes with its
ids; ``padded`` fills them up to the bucket's length.

Scale: the histogram has at most MAX_TOKENS rows whatever the corpus; pieces are numbered in a bucket by slices, so no
bucket is gathered in one task; text does not leave its scan, ids are stored once and dealt once.

Defined results: a null or empty text is one piece, its end token; a text of any length is kept whole in its pieces;
repeated rows are packed each; ids that tie are ordered by a row number; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import slices
from textloom.llm.common import dense_slots, materialise
from textloom.llm.fragments import codes

MAX_TOKENS = 8192
BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Size of a stored id, little-endian; a tokenizer with larger ids is refused.
ID_BYTES = 2
_KIND = "<u2"
#: The token that ends each text: the end of text of ``byte_bpe_50k``; pass another tokenizer's own.
END_ID = 50_256


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bucket lengths, at most ``buckets``, for which padding every piece to the next one costs least.

    lengths: distinct and ascending. best[j] is the least padding of the first j lengths; a bucket over lengths i..j-1
    costs lengths[j-1] * pieces - tokens.
    """
    n = len(lengths)
    pieces = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    tokens = np.concatenate(([0], np.cumsum(lengths * counts))).astype(np.int64)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        now, cut = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], cut[j] = cost[i], i
        choice.append(cut)
        best = now
    out, j = [], n
    for cut in reversed(choice):
        if cut[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def encoded(df: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, the end token included; ids are unsigned ``ID_BYTES``-byte numbers in a row."""
    end = np.array([end_id], _KIND).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codes(path)
        if (most := max([end_id, *coder.vocab.values(), *coder.specials])) >= 1 << 8 * ID_BYTES:
            raise ValueError(f"token id {most} does not fit in {ID_BYTES} bytes")
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.frombuffer(coder.encode(t), np.uint32).astype(_KIND).tobytes() + end for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // ID_BYTES for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_tokens long, ids binary")


def pack(rows: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Per piece of (doc_id, n_tokens, ids) rows: its tokens, bucket length, batch in the bucket, place in the batch, padding, ids.

    ``rows`` may be without ids; then so are the pieces.
    """
    extra = ["ids"] if "ids" in rows.columns else []
    numbered = materialise(rows.select("doc_id", "n_tokens", *extra, F.monotonically_increasing_id().alias("tie")), "token-ids")
    last = F.expr(f"(n_tokens - 1) div {max_tokens}")
    pieces = numbered.select("doc_id", "tie", "n_tokens", *extra, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    tokens = F.least(F.lit(max_tokens), F.col("n_tokens") - F.col("piece") * max_tokens).cast("int")
    cut = [F.substring("ids", (F.col("piece") * (max_tokens * ID_BYTES) + 1).cast("int"), F.lit(max_tokens * ID_BYTES)).alias("ids")] if extra else []
    pieces = pieces.select("doc_id", "tie", "piece", tokens.alias("piece_tokens"), *cut)
    hist = sorted(tuple(r) for r in pieces.groupBy("piece_tokens").agg(F.count(F.lit(1))).collect())  # at most max_tokens rows
    bounds = bucket_lengths(np.array([h[0] for h in hist], np.int64), np.array([h[1] for h in hist], np.int64), buckets)
    bucket = F.lit(None).cast("int")
    for b in reversed(bounds):
        bucket = F.when(F.col("piece_tokens") <= b, F.lit(b)).otherwise(bucket)
    placed = dense_slots(pieces.withColumn("bucket_tokens", bucket), ["bucket_tokens"], ["doc_id", "piece", "tie"], "_slot")
    per = F.greatest(F.expr(f"{budget}L div bucket_tokens"), F.lit(1))
    return placed.select(
        "doc_id",
        "piece",
        "piece_tokens",
        "bucket_tokens",
        F.floor(F.col("_slot") / per).alias("batch"),
        (F.col("_slot") % per).alias("place"),
        (F.col("bucket_tokens") - F.col("piece_tokens")).alias("padding"),
        *extra,
    )


def padded(packed: DataFrame, pad_id: int = END_ID) -> DataFrame:
    """Packed pieces with their ids filled up with ``pad_id`` to the bucket's length: the rows of each batch, all of one size."""
    fill = F.lit(np.array([pad_id], _KIND).tobytes())
    return packed.withColumn("ids", F.rpad("ids", F.col("bucket_tokens") * ID_BYTES, fill))


def report(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(encoded(df, path, doc_id=doc_id, text=text))
