"""Token-id files of directly addressable codes (operator 5).

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, level 1 the second chunk of
the ids that have one, and so on. A bitmap beside each level but the last says which ids go on, and a rank directory
counts its set bits per block, so the place of an id in the next level is one directory entry and a few bytes of bitmap:
any id is read with one step a level and no block is decoded.

Documents are encoded in ascending id order and cut into segments at document ends. A segment is one row (bytes plus its
documents' ids and lengths) of an uncompressed Parquet dataset in shared storage, written by Spark's own writer, so any file
system and any lost task are covered by its commit protocol. A segment knows how many ids its part has before it; the
offset index, a small table beside the segments, has the global place of each. ``lookup`` finds the segments of the places
asked for in the index and reads single ids by ``Packed.at``; no segment without such a place is read.

Defined results: a null or empty text has the end id alone; equal ids keep the order of a hash of their texts; texts of
any length are whole (a segment grows with its longest document); extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import sized, stored_path
from textloom.llm.fragments import codes

MAGIC = b"TLDAC1"
#: Ids in a segment, until the document that passes it ends.
SEGMENT_IDS = 1 << 18
#: Bits of a bitmap that share a rank directory entry.
RANK_BITS = 512
SEGMENT_SCHEMA = "part int, seg int, base long, n_ids long, doc_ids array<long>, lens array<long>, blob binary"


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    levels, bitmaps, rest = [], [], np.asarray(ids, np.uint32)
    while True:
        levels.append((rest & np.uint32(0xFF)).astype(np.uint8))
        more = rest > 0xFF
        if not more.any():
            break
        bitmaps.append(more)
        rest = rest[more] >> np.uint32(8)
    out = [MAGIC, struct.pack("<BB", len(levels), 8), struct.pack(f"<{len(levels)}Q", *map(len, levels))]
    for k, level in enumerate(levels):
        out.append(level.tobytes())
        if k < len(bitmaps):
            bits = np.packbits(bitmaps[k], bitorder="little")
            ones = np.add.reduceat(bitmaps[k], np.arange(0, len(bitmaps[k]), RANK_BITS), dtype=np.uint64)
            out += [bits.tobytes(), np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint64).tobytes()]
    return b"".join(out)


class Packed:
    """Read access to packed ids without copying them."""

    def __init__(self, blob: bytes):
        if blob[:6] != MAGIC:
            raise ValueError("not a packed id segment")
        n, _ = struct.unpack_from("<BB", blob, 6)
        counts, at = struct.unpack_from(f"<{n}Q", blob, 8), 8 + 8 * n
        self.levels, self.bits, self.ranks = [], [], []
        for k, count in enumerate(counts):
            self.levels.append(np.frombuffer(blob, np.uint8, count, at))
            at += count
            if k + 1 < n:
                size, blocks = (count + 7) // 8, (count + RANK_BITS - 1) // RANK_BITS
                self.bits.append(np.frombuffer(blob, np.uint8, size, at))
                self.ranks.append(np.frombuffer(blob[at + size : at + size + 8 * blocks], np.uint64))
                at += size + 8 * blocks

    def __len__(self) -> int:
        return len(self.levels[0])

    def at(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[i]) << (8 * k)
            if k == len(self.bits) or not self.bits[k][i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            inside = int.from_bytes(self.bits[k][block * RANK_BITS // 8 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * RANK_BITS)) - 1)
            i = int(self.ranks[k][block]) + inside.bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = self.levels[-1].astype(np.uint32)
        for k in range(len(self.bits) - 1, -1, -1):
            more = np.unpackbits(self.bits[k], count=len(self.levels[k]), bitorder="little").astype(bool)
            upper, out = out, self.levels[k].astype(np.uint32)
            out[more] |= upper << np.uint32(8)
        return out


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``text`` and write segments and index to ``path`` in ascending id order, ``end_id`` after each document."""
    end = struct.pack("=I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = codes(tokenizer), TaskContext.get().partitionId()
        seg, base, n, docs, lens, held = 0, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint32)
            row = [[part], [seg], [base], [n], [docs], [lens], [pack(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "seg", "base", "n_ids", "doc_ids", "lens", "blob"])

        for batch in batches:
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                code = coder.encode(t.as_py()) + end
                docs.append(doc)
                lens.append(len(code) // 4)
                held.append(code)
                n += len(code) // 4
                if n >= SEGMENT_IDS:
                    yield flush()
                    seg, base, n, docs, lens, held = seg + 1, base + n, 0, [], [], []
        if docs:
            yield flush()

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "none").parquet(f"{path}/segments")
    stored = segments(df.sparkSession, path).select("part", "seg", "base", "n_ids", F.size("lens").alias("docs"))
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each part of the write
    starts = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    # as many rows as the write had tasks, so this side always fits in memory
    placed = stored.join(F.broadcast(starts), "part")
    placed.select("part", "seg", (F.col("part_start") + F.col("base")).alias("start"), "n_ids", "docs").write.parquet(f"{path}/index")


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index: (part, seg, start, n_ids, docs) of each segment."""
    return spark.read.schema("part int, seg int, start long, n_ids long, docs int").parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 of all its ids and last_id read by its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes_ = Packed(batch.column("blob")[i].as_py())
                ids = codes_.all()
                lens = np.array(batch.column("lens")[i].as_py(), np.int64)
                ends = np.cumsum(lens)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lens.tolist(), ends.tolist(), strict=True)]
                last = [codes_.at(e - 1) for e in ends.tolist()]
                row = [batch.column("doc_ids")[i].values, pa.array(batch.column("start")[i].as_py() + ends - lens), pa.array(lens), pa.array(crcs, pa.int64()), pa.array(last, pa.int64())]
                yield pa.RecordBatch.from_arrays(row, ["doc_id", "start", "n_tokens", "ids_crc32", "last_id"])

    # the index has a row for every SEGMENT_IDS ids; a broadcast only if that is few
    rows = segments(spark, path).join(sized(index(spark, path).select("part", "seg", "start")), ["part", "seg"])
    return rows.select("start", "doc_ids", "lens", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long")


def lookup(places: DataFrame, path: str, place: str = "place") -> DataFrame:
    """(place, id) of every global place in ``places`` that the files have, each read by its address alone."""
    spark = places.sparkSession
    asked = places.select(F.col(place).cast("long").alias("place")).distinct()
    # ranges of SEGMENT_IDS places: a segment lies in the ranges it reaches, a place in one
    cell = F.expr(f"place div {SEGMENT_IDS}L")
    reach = F.sequence(F.expr(f"start div {SEGMENT_IDS}L"), F.expr(f"(start + n_ids - 1) div {SEGMENT_IDS}L"))
    cells = index(spark, path).select("part", "seg", "start", "n_ids", F.explode(reach).alias("cell"))
    found = asked.withColumn("cell", cell).join(cells, "cell").filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_ids")))
    wanted = found.groupBy("part", "seg", "start").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes_, start = Packed(batch.column("blob")[row].as_py()), batch.column("start")[row].as_py()
                at = batch.column("places")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([codes_.at(p - start) for p in at], pa.int64())], ["place", "id"])

    rows = segments(spark, path).select("part", "seg", "blob").join(wanted, ["part", "seg"])
    return rows.select("start", "places", "blob").mapInArrow(run, "place long, id long")


def report(df: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of ``df`` to shared storage and read them back."""
    spark = df.sparkSession
    path = stored_path(spark, "tokens")
    write(df, path, tokenizer, end_id, doc_id, text)
    return read(spark, path)
