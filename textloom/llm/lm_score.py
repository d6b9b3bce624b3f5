"""Language-model scoring by deleted interpolation (operator 11).

An n-gram model whose maximum-likelihood estimates of all orders, and a uniform share for what was never seen, are mixed.
The mixture's weights depend on how frequent the context is (powers of two of its count, one set for each order the context
is known at). They are learned by expectation-maximisation: the training documents are split by a hash in a retained part,
which gives the estimates, and a deleted part, whose n-grams the mixture must explain. Scores use the counts of both parts.

Scale: documents are read once and kept as blocks of word hashes, about two bytes a token. Each block's distinct n-grams go,
with their counts, as sorted arrays to ranges of the hash; a range adds up the counts of all blocks and sends each block
the totals of its own n-grams. The number of ranges follows the number of tokens, so a range stays near ``RANGE_TOKENS``
entries; a frequent n-gram adds one entry a block to its range. One order is counted after the other, so that the shuffle
files of one are gone before the next. One row a bucket comes to the driver in each round of EM.

Defined results: a null or empty text has one token, its end; texts are read whole, and one of any length goes through
in pieces and spans blocks; rows that repeat are scored and learned from one by one; a null id is a training document;
without training documents every score is 0; where the retained or the deleted part is empty all components weigh the same;
an empty table gives an empty result; other columns are ignored. N-grams are known by 64 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import discard, materialise
from textloom.llm.fragments import release

ORDER = 3
#: Tokens of a block, and tokens (so at most n-grams of one order) that a range of hashes sums at once, on average.
BLOCK_TOKENS = 1 << 19
RANGE_TOKENS = 1 << 20
#: One training document in so many is deleted from the counts that the weights are learned with.
DELETED_ONE_IN = 10
ROUNDS = 15
#: Every component of a bucket has this many pseudo-observations, so no weight becomes 0.
PSEUDO = 0.5
RETAINED, DELETED, HELD_OUT = 0, 1, 2

#: Bytes that are hashed at once; a longer word is hashed as one string of bytes, as is every word of over LONG bytes.
_PIECE, _LONG = 1 << 20, 1 << 12
_U = np.uint64
_BASE, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
END, START = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def part(doc_id: Column, text: Column) -> Column:
    """RETAINED, DELETED or HELD_OUT; the training part by id and text, so that null or equal ids do not fall together."""
    deleted = F.pmod(F.xxhash64(doc_id, text, F.lit(29)), F.lit(DELETED_ONE_IN)) == 0
    return F.when(held_out(doc_id), HELD_OUT).when(deleted, DELETED).otherwise(RETAINED)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of the base and of its inverse modulo 2**64."""
    n = _PIECE + _LONG + 2
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return mixed(np.arange(1, 257, dtype=_U) * _BASE), np.cumprod(up), np.cumprod(down)


def _hashed(data: bytes) -> np.ndarray:
    """Hashes of the words of a piece, by differences of a running polynomial."""
    at = np.frombuffer(data, np.uint8)
    solid = np.concatenate([[False], ~_BLANK[at], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edges[::2], edges[1::2]
    values, up, down = _powers()
    running = np.concatenate([np.zeros(1, _U), np.cumsum(values[at] * up[: len(at)])])
    out = mixed((running[end] - running[begin]) * down[begin] + (end - begin).astype(_U) * _MIX2)
    for i in np.flatnonzero(end - begin > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    return out


def word_hashes(text: str) -> Iterator[np.ndarray]:
    """Hashes of the words of a text, A-Z in lower case, piece by piece."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_LOWER), 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        if stop < len(data):  # cut behind a blank; look for the next one if the piece is a single word
            near = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8, stop - at, at)])
            while not len(near) and stop < len(data):
                far = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8, min(_PIECE, len(data) - stop), stop)])
                near, stop = (far + (stop - at), stop) if len(far) else (near, min(len(data), stop + _PIECE))
            stop = at + int(near[-1 if near[-1] < _PIECE else 0]) + 1 if len(near) else len(data)
        if stop - at > _PIECE + 1:  # blanks may lead to one long word
            piece = data[at:stop].strip(b" \t\n\r\x0b\x0c")
            yield np.array([xxhash.xxh3_64_intdigest(piece)], _U) if piece else np.zeros(0, _U)
        else:
            yield _hashed(data[at:stop])
        at = stop


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all their first bytes first: most high bytes are 0 and compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _small(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in full."""
    counts = counts.astype(np.uint64)
    return np.minimum(counts, _U(255)).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()


def _from_small(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, _U, offset=n)
    return out


class _Builder:
    """Gathers documents of one part to blocks. A document that goes on in the next block repeats its last tokens there."""

    def __init__(self, kind: int, order: int, limit: int, number: Callable[[], int]):
        self.kind, self.overlap, self.limit, self.number = kind, order - 1, max(limit, 2 * order), number
        self._begin()

    def _begin(self) -> None:
        self.block, self.tokens, self.n = self.number(), [], 0
        self.rows: list[int] = []
        self.ids: list = []
        self.sizes: list[int] = []
        self.repeats: list[int] = []

    def open(self, doc_id: object, row: int | None = None, again: np.ndarray | None = None) -> None:
        self.rows.append(self.block << 20 | len(self.rows) if row is None else row)
        self.ids.append(doc_id)
        self.sizes.append(0 if again is None else len(again))
        self.repeats.append(self.sizes[-1])
        if again is not None:
            self.tokens.append(again)
            self.n += len(again)

    def add(self, tokens: np.ndarray) -> Iterator[dict]:
        while len(tokens):
            now, tokens = tokens[: max(1, self.limit - self.n)], tokens[max(1, self.limit - self.n) :]
            self.tokens.append(now)
            self.n += len(now)
            self.sizes[-1] += len(now)
            if self.n >= self.limit and len(tokens):
                doc_id, row = self.ids[-1], self.rows[-1]
                last = np.concatenate(self.tokens[-self.overlap - 1 :])[-min(self.overlap, self.sizes[-1]) :] if self.overlap else None
                yield self.close()
                self.open(doc_id, row, last)

    def close(self) -> dict:
        distinct, at = np.unique(np.concatenate(self.tokens), return_inverse=True)
        out = {"block": self.block, "part": self.kind, "tokens": self.n - sum(self.repeats), "docs": sum(r == 0 for r in self.repeats), "distinct": distinct.tobytes(), "at": _planes(at)}
        out |= {"rows": self.rows, "ids": self.ids, "sizes": self.sizes, "repeats": self.repeats}
        self._begin()
        return out


#: Documents of a block at most; a document's row number has 20 bits within its block.
_BLOCK_DOCS = 1 << 20


def blocks(df: DataFrame, order: int, doc_id: str, text: str, block_tokens: int) -> DataFrame:
    """Blocks of word hashes with the documents they belong to, each of one part of the corpus."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), part(F.col(doc_id), whole).alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        made = [TaskContext.get().partitionId() << 20]

        def number() -> int:
            made[0] += 1
            return made[0]

        builders, schema = [_Builder(k, order, block_tokens, number) for k in (RETAINED, DELETED, HELD_OUT)], None

        def row(block: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block], schema)

        for batch in batches:
            own = batch.schema.field("doc_id").type
            fields = [("block", pa.int64()), ("part", pa.int32()), ("tokens", pa.int64()), ("docs", pa.int64()), ("distinct", pa.binary()), ("at", pa.binary())]
            schema = pa.schema([*fields, ("rows", pa.list_(pa.int64())), ("ids", pa.list_(own)), ("sizes", pa.list_(pa.int64())), ("repeats", pa.list_(pa.int64()))])
            for i, t, p in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("part").to_pylist(), strict=True):
                b = builders[p]
                b.open(i)
                for piece in word_hashes(t.as_py()):
                    yield from map(row, b.add(piece))
                yield from map(row, b.add(np.array([END])))
                if b.n >= b.limit or len(b.rows) >= _BLOCK_DOCS - 1:
                    yield row(b.close())
        for b in builders:
            if b.n:
                yield row(b.close())

    return rows.mapInArrow(run, f"block long, part int, tokens long, docs long, distinct binary, at binary, rows array<long>, ids array<{kind}>, sizes array<long>, repeats array<long>")


@dataclass
class _Block:
    """The token hashes of a block and the n-gram hashes that end at each token."""

    tokens: np.ndarray
    first: np.ndarray  # where its documents begin
    place: np.ndarray  # of each token in its document, as far as this block knows
    counted: np.ndarray  # false for tokens that the block before has counted

    @staticmethod
    def of(row: dict) -> _Block:
        tokens = np.frombuffer(row["distinct"], _U)[_from_planes(row["at"])]
        sizes, repeats = np.asarray(row["sizes"], np.int64), np.asarray(row["repeats"], np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(tokens)) - np.repeat(first, sizes)
        return _Block(tokens, first, place, place >= np.repeat(repeats, sizes))

    def longer(self, shorter: np.ndarray, n: int) -> np.ndarray:
        """Hashes of n-grams from those of (n-1)-grams that end one token before."""
        before = np.empty_like(shorter)
        before[1:] = shorter[:-1]
        before[self.place == 0] = START
        return mixed(before * _BASE + self.tokens + _U(n))

    def hashes(self, n: int) -> np.ndarray:
        out = self.tokens
        for k in range(2, n + 1):
            out = self.longer(out, k)
        return out


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n ranges begins in the sorted hashes."""
    tops = np.array([((i << 32) + n - 1) // n << 32 for i in range(n)], _U)
    return np.append(np.searchsorted(hashes, tops), len(hashes))


_ENTRY = pa.schema([("n", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ENTRY_DDL = "n int, range int, block long, part int, hashes binary, counts binary"
_ANSWER = pa.schema([("n", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("retained", pa.binary()), ("learned", pa.binary()), ("known", pa.int64())])
_ANSWER_DDL = "n int, range int, block long, part int, size int, retained binary, learned binary, known long"


def _entries(n: int, row: dict, ranges: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct n-grams and their counts, cut by ranges."""
    block = _Block.of(row)
    distinct, at = np.unique(block.hashes(n), return_inverse=True)
    counts = np.bincount(at, weights=block.counted, minlength=len(distinct))
    cuts = _ranges(distinct, ranges)
    rows = [(r, distinct[a:b].tobytes(), _small(counts[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
    numbers, keys, values = zip(*rows, strict=True)
    k = len(rows)
    yield pa.RecordBatch.from_arrays([pa.array([n] * k, pa.int32()), pa.array(numbers, pa.int32()), pa.array([row["block"]] * k, pa.int64()), pa.array([row["part"]] * k, pa.int32()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], schema=_ENTRY)


def _sum_range(table: pa.Table) -> pa.Table:
    """All blocks' entries of one range: totals by part, and for each block those of its own n-grams.

    The totals of the retained part go to the blocks of the deleted part only.
    """
    keys = [np.frombuffer(x.as_py(), _U) for x in table.column("hashes")]
    counts = np.concatenate([_from_small(x.as_py(), len(k)) for x, k in zip(table.column("counts"), keys, strict=True)]).astype(np.float64)
    parts = np.asarray(table.column("part"))
    kinds = np.repeat(parts, [len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    retained, deleted = (np.bincount(at, weights=np.where(kinds == k, counts, 0), minlength=len(distinct)) for k in (RETAINED, DELETED))
    learned, stops = retained + deleted, np.cumsum([len(k) for k in keys])
    slices = [at[b - len(k) : b] for k, b in zip(keys, stops, strict=True)]
    told = [_small(retained[x]) if p == DELETED else b"" for x, p in zip(slices, parts, strict=True)]
    known = [int((learned > 0).sum()), *[0] * (len(keys) - 1)]
    columns = [pa.array([len(k) for k in keys], pa.int32()), pa.array(told, pa.binary()), pa.array([_small(learned[x]) for x in slices], pa.binary()), pa.array(known, pa.int64())]
    return pa.Table.from_arrays([*(table.column(c) for c in ("n", "range", "block", "part")), *columns], schema=_ANSWER)


class _Counts:
    """Counts of the n-grams that end at each token of a block: in the retained part or in all training documents."""

    def __init__(self, row: dict, answers: pa.Table, order: int, which: str):
        self.block, self.by_order = _Block.of(row), []
        rows = sorted(answers.select(["n", "range", "size", which]).to_pylist(), key=lambda r: (r["n"], r["range"]))
        for n in range(1, order + 1):
            found = np.concatenate([_from_small(r[which], r["size"]) for r in rows if r["n"] == n])
            self.by_order.append(found[np.unique(self.block.hashes(n), return_inverse=True)[1]])


def _log_bucket(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(np.float64))[1]  # the bit length


#: Buckets of one order's contexts; counts have at most 62 bits.
_SPAN = 64


def estimates(known: _Counts, docs: int, tokens: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, probability by component) of each token; component 0 is uniform over the known words and one unknown."""
    order, place = len(known.by_order), known.block.place
    counts = [c.astype(np.float64) for c in known.by_order]
    p = np.zeros((order + 1, len(place)))
    p[0] = 1.0 / (words + 1)
    p[1] = counts[0] / max(tokens, 1)
    bucket = np.full(len(place), _SPAN)
    for n in range(2, order + 1):
        context = np.empty(len(place))
        context[1:] = counts[n - 2][:-1]
        context[place == 0] = docs
        np.divide(counts[n - 1], context, out=p[n], where=context > 0)
        bucket = np.where(context > 0, n * _SPAN + _log_bucket(context), bucket)
    return bucket, p


def _components(bucket: int) -> int:
    """How many components a bucket mixes: the uniform one and the orders up to that of its context."""
    return bucket // _SPAN + 1


def start_weights(buckets: int, order: int) -> np.ndarray:
    out = np.zeros((buckets, order + 1))
    for b in range(buckets):
        k = min(_components(b), order + 1)
        out[b, :k] = 1.0 / k
    return out


def better_weights(sums: np.ndarray, order: int) -> np.ndarray:
    """Weights from the expected numbers of tokens by bucket and component."""
    out = start_weights(len(sums), order)
    for b in range(len(sums)):
        k = min(_components(b), order + 1)
        out[b, :k] = (sums[b, :k] + PSEUDO) / (sums[b, :k].sum() + k * PSEUDO)
    return out


def filled(weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Buckets without a deleted token take the weights of the nearest one of the same order, the rarer first."""
    out = weights.copy()
    for level in range(1, len(weights) // _SPAN):
        have = [b for b in range(level * _SPAN, (level + 1) * _SPAN) if seen[b] > 0]
        for b in range(level * _SPAN, (level + 1) * _SPAN):
            if have and seen[b] <= 0:
                out[b] = weights[min(have, key=lambda h: (abs(h - b), h))]
    return out


@dataclass
class Model:
    """The mixture and the sizes that its estimates need; the counts stay in their tables."""

    order: int
    docs: int
    tokens: int
    words: int
    weights: np.ndarray


def _cogrouped(kept: DataFrame, answers: DataFrame, run: Callable[[dict, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` of each block, as a dict, and the answers on its n-grams."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.to_pylist()[0], right)

    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, schema)


def _expected(weights: np.ndarray, order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, order + 1))
        for batch in batches:
            for b, p in zip(batch.column("bucket"), batch.column("p"), strict=True):
                bucket = np.frombuffer(b.as_py(), np.uint16)
                share = np.frombuffer(p.as_py(), np.float32).reshape(order + 1, -1) * weights[bucket].T
                share /= share.sum(0)
                for k in range(order + 1):
                    sums[:, k] += np.bincount(bucket, weights=share[k], minlength=size)
        b, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(sums[b, k])], ["bucket", "k", "n"])

    return run


def learn(kept: DataFrame, answers: DataFrame, order: int, rounds: int = ROUNDS) -> Model:
    """Mixture weights by EM on the tokens of the deleted part, with the counts of the retained part."""
    total = {r["part"]: r for r in kept.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()}  # three rows
    docs, tokens = ({k: int(total[k][c]) if k in total else 0 for k in (RETAINED, DELETED)} for c in ("docs", "tokens"))
    words = int(answers.filter("n = 1").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"])
    size = (order + 1) * _SPAN
    weights = start_weights(size, order)
    model = Model(order, sum(docs.values()), sum(tokens.values()), words, weights)
    if not model.docs:
        weights[:] = np.eye(1, order + 1)
    if not docs[RETAINED] or not docs[DELETED]:
        return model

    def tell(row: dict, found: pa.Table) -> pa.Table:
        known = _Counts(row, found, order, "retained")
        bucket, p = estimates(known, docs[RETAINED], tokens[RETAINED], words)
        use = known.block.counted
        return pa.table({"bucket": pa.array([bucket[use].astype(np.uint16).tobytes()], pa.binary()), "p": pa.array([p[:, use].astype(np.float32).tobytes()], pa.binary())})

    deleted = kept.filter(F.col("part") == DELETED)
    told = materialise(_cogrouped(deleted, answers.filter(F.col("part") == DELETED), tell, "bucket binary, p binary"), "lm-deleted")
    sums = np.zeros((size, order + 1))
    for _ in range(rounds):
        rows = told.mapInArrow(_expected(weights, order), "bucket int, k int, n double").groupBy("bucket", "k").agg(F.sum("n").alias("n")).collect()  # a row a bucket and component
        sums = np.zeros((size, order + 1))
        for r in rows:
            sums[r["bucket"], r["k"]] = r["n"]
        weights = better_weights(sums, order)
    discard(told)
    model.weights = filled(weights, sums.sum(1))
    return model


def counted(df: DataFrame, order: int, doc_id: str, text: str, block_tokens: int, range_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, the counts of their n-grams): both stored."""
    kept = materialise(blocks(df, order, doc_id, text, block_tokens), "lm-blocks", "zstd")
    tokens = kept.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    ranges, answers = max(1, -(-tokens // range_tokens)), None
    for n in range(1, order + 1):

        def cut(batches: Iterator[pa.RecordBatch], n: int = n) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _entries(n, row, ranges)

        entries = kept.select("block", "part", "distinct", "at", "sizes", "repeats").mapInArrow(cut, _ENTRY_DDL)
        found = materialise(entries.groupBy("n", "range").applyInArrow(_sum_range, _ANSWER_DDL), "lm-counts", "zstd")
        answers = found if answers is None else answers.unionByName(found)
    return kept, answers


def score(kept: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score."""
    kind = kept.schema["ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def run(row: dict, found: pa.Table) -> pa.Table:
        known = _Counts(row, found, model.order, "learned")
        bucket, p = estimates(known, model.docs, model.tokens, model.words)
        use = known.block.counted
        logs = np.where(use, np.log10((p * model.weights[bucket].T).sum(0)), 0.0)
        base = np.where(use, np.log10((known.by_order[0] + 1) / (model.tokens + model.words + 1)), 0.0)
        add = lambda x: np.add.reduceat(x, known.block.first)
        columns = {"row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(row["ids"], arrow), "part": pa.array([row["part"]] * len(row["rows"]), pa.int32())}
        columns |= {"n_tokens": pa.array(add(use.astype(np.int64))), "n_known": pa.array(add((use & (known.by_order[0] > 0)).astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(logs))}
        return pa.table(columns)

    pieces = _cogrouped(kept, answers, run, f"row long, doc_id {kind.simpleString()}, part int, n_tokens long, n_known long, base_score double, score double")
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("part").alias("part"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", (F.col("part") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Train on ``df`` and score each of its documents. The stored blocks and counts are read when the result is."""
    kept, answers = counted(df, order, doc_id, text, block_tokens, range_tokens)
    return score(kept, answers, learn(kept, answers, order))
