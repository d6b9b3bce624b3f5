"""BPE encoding and decoding with forced-boundary splitting (operator 6).

Byte pairs that stand inside no vocabulary token are certain cuts: no merge can cross them. Texts are cut there,
fragments are encoded independently and their ids concatenated; see ``fragments``. Decoding joins the bytes of the
tokens and reads them as UTF-8 with replacement characters, as the library does.

Scale: a map over Arrow batches, no shuffle; a worker holds the tokenizer, a bounded cache and one slice of rows.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens written in a text become
their ids, as the library does; texts of any length are encoded whole; repeated rows give equal results; extra columns
are kept by ``encode`` and ``decode``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.fragments import FragmentCodes, codes

#: Bytes of text that a worker expands at once.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes in ``column`` each."""
    col = batch.column(column)
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(col) if not pa.types.is_list(col.type) else pc.multiply(pc.list_value_length(col), 4), 0)
    part = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def _decoder(coder: FragmentCodes) -> list[bytes]:
    table = [b""] * (max([*coder.vocab.values(), *coder.specials]) + 1)
    for token, i in coder.vocab.items():
        table[i] = coder.token_bytes(token)
    for i, content in coder.specials.items():
        table[i] = content.encode()
    return table


def decode_ids(table: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids."""
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codes(path)
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), id_lists([coder.encode(t) for t in part.column(text).to_pylist()])], schema.fieldNames())

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of token ids; null ids give the empty text."""
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _decoder(codes(path))
        for batch in batches:
            for part in slices(batch, ids):
                texts = [decode_ids(table, np.array(x or [], np.int64)) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], schema.fieldNames())

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) in one pass: the ids of each text and the text that those ids decode to."""
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codes(path)
        table = _decoder(coder)
        for batch in batches:
            for part in slices(batch, "text"):
                encoded = [coder.encode(t) for t in part.column("text").to_pylist()]
                texts = [decode_ids(table, np.frombuffer(x, np.uint32)) for x in encoded]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), id_lists(encoded), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def report(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens and digests of the ids and of the decoded text."""
    return round_trip(df, path, doc_id, text).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
