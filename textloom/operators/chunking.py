"""Chunkers. Fixed-size chunks are column expressions; the recursive and the semantic chunker are ordered folds over one
document and run row by row in Python. Tokens are runs of characters with the white space before them, so a chunk's
tokens joined are its text; any tokenizer with ``split`` to such pieces can take their place."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.columns import dot, let, norm

SIZE, OVERLAP, MIN_TOKENS = 512, 50, 128
#: Separators from the largest to the smallest (fixed values).
SEPARATORS = ("\n\n", "\n", ". ", " ")
TOKEN = r"\s*\S+"
CHUNKS = "array<struct<chunk_index:int,text:string,token_count:int,start_token:int,end_token:int,overlap_prefix_tokens:int>>"


def token_column(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\s*\S+"), F.lit(0))


def fixed_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (chunk_index, start_token, end_token, token_count, text); no tail that is only overlap; empty for no token."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap

    def cut(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - overlap - 1), F.lit(step))
        made = F.transform(
            starts,
            lambda s, i: F.struct(
                i.alias("chunk_index"),
                s.alias("start_token"),
                F.least(s + size, F.size(tokens)).alias("end_token"),
                F.least(F.lit(size), F.size(tokens) - s).alias("token_count"),
                T.strip(F.array_join(F.slice(tokens, s + 1, F.lit(size)), "")).alias("text"),
            ),
        )
        return F.filter(made, lambda c: c["token_count"] > 0)

    return let(token_column(text), cut)


def chunk_fixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return df.select(id_col, F.explode(fixed_chunks(F.col(text), size, overlap)).alias("c")).select(id_col, "c.*")


@dataclass(frozen=True)
class Tokenizer:
    """Cuts a text into pieces whose concatenation is the text without trailing white space."""

    pattern: re.Pattern = re.compile(TOKEN)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, text: str) -> int:
        return len(text.split()) if self.pattern.pattern == TOKEN else len(self.split(text))

    def tail(self, text: str, n: int) -> str:
        """The last ``n`` tokens and what white space follows them."""
        pieces = self.split(text)
        return "" if n <= 0 else text if len(pieces) <= n else text[sum(map(len, pieces[:-n])) :]


def split_pieces(text: str, size: int, tok: Tokenizer, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Pieces of at most ``size`` tokens, cut at the largest separator that helps; separators stay with the left piece.

    What no separator can cut is cut between tokens so that each has the most that fit.
    """
    if tok.count(text) <= size:
        if text:
            yield text
        return
    at = next((k for k, s in enumerate(separators) if s in text), None)
    if at is None:
        tokens, start, step = tok.split(text), 0, max(1, size)
        for i in range(0, len(tokens), step):
            end = len(text) if i + step >= len(tokens) else start + sum(map(len, tokens[i : i + step]))
            yield text[start:end]
            start = end
        return
    parts = text.split(separators[at])
    for i, part in enumerate(parts):
        piece = part + separators[at] if i + 1 < len(parts) else part
        if piece and tok.count(piece) <= size:
            yield piece
        elif piece:
            yield from split_pieces(piece, size, tok, separators[at + 1 :])


def merge_pieces(pieces: Iterator[str], size: int, overlap: int, tok: Tokenizer) -> list[str]:
    """Greedy packing; each chunk after the first starts with the last ``overlap`` tokens of the one before."""
    done, held, room = [], [], 0
    for piece in pieces:
        n = tok.count(piece)
        if held and room + n > size:
            done.append("".join(held))
            seed = tok.tail(done[-1], overlap) if overlap > 0 else ""
            held, room = ([seed], tok.count(seed)) if seed else ([], 0)
        held.append(piece)
        room += n
    return done + ["".join(held)] if held else done


def recursive_chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP, tok: Tokenizer = Tokenizer()) -> list[dict]:
    """Chunks with token offsets, searched near where the one before ended; the running offset when not found there."""
    if not text or not text.strip():
        return []
    whole, out, at = [p.strip() for p in tok.split(text)], [], 0
    for i, chunk in enumerate(merge_pieces(split_pieces(text, size, tok), size, overlap, tok)):
        own = [p.strip() for p in tok.split(chunk)]
        last = min(at + overlap, len(whole) - len(own))
        start = next((s for s in range(max(0, at - overlap), last + 1) if whole[s : s + len(own)] == own), at)
        out.append({"chunk_index": i, "text": chunk, "token_count": len(own), "start_token": start, "end_token": start + len(own), "overlap_prefix_tokens": None})
        at = start + len(own)
    return out


@lru_cache(1 << 16)
def _crc(word: str) -> int:
    return zlib.crc32(word.encode())


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """Deterministic stand-in for an embedding model: signed hashed words, unit length."""
    v = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        h = _crc(w)
        v[h % dim] += 1.0 if h >> 31 else -1.0
    n = math.sqrt(math.sumprod(v, v)) or 1e-10
    return [x and x / n for x in v]


def breakpoints(vectors: list[list[float]], deviations: float = 1.0) -> list[bool]:
    """Whether to break after each vector but the last: neighbour cosine below mean - deviations * population std."""
    sizes = [math.sqrt(sum(map(mul, v, v))) or 1e-10 for v in vectors]
    sims = [sum(map(mul, a, b)) / (m * n) for a, b, m, n in zip(vectors, vectors[1:], sizes, sizes[1:], strict=False)]
    if not sims:
        return []
    mean = sum(sims) / len(sims)
    std = math.sqrt(sum((s - mean) ** 2 for s in sims) / len(sims))
    return [s < mean - deviations * std for s in sims]


_SENTENCE = re.compile(rf"(?<=[{T.TERMINATORS}])\s+")


def semantic_chunks(text: str | None, embed: Callable[[str], list[float]] = hashed_embedding, size: int = SIZE, overlap: int = OVERLAP, least: int = MIN_TOKENS, deviations: float = 1.0, tok: Tokenizer = Tokenizer()) -> list[dict]:
    """Sentences packed up to a ceiling and broken where neighbours differ; chunks are seeded with the tail of the last."""
    raw = [s for s in _SENTENCE.split((text or "").strip()) if s.strip()]
    if not raw:
        return []
    if len(raw) == 1:
        if tok.count(text) <= size:
            n = tok.count(text)
            return [{"chunk_index": 0, "text": text, "token_count": n, "start_token": 0, "end_token": n, "overlap_prefix_tokens": None}]
        pieces, step = tok.split(text), size - overlap
        starts = [s for s in range(0, len(pieces), step) if s == 0 or s - step + size < len(pieces)]
        return [{"chunk_index": i, "text": "".join(pieces[s : s + size]).strip(), "token_count": len(pieces[s : s + size]), "start_token": s, "end_token": min(s + size, len(pieces)), "overlap_prefix_tokens": None} for i, s in enumerate(starts)]
    sentences = []
    for s in raw:
        if tok.count(s) <= size:
            sentences.append(s)
            continue
        pieces = tok.split(s)
        sentences += ["".join(pieces[i : i + size]).strip() for i in range(0, len(pieces), size)]
    breaks = [*breakpoints([embed(s) for s in sentences], deviations), False]
    out: list[dict] = []
    held, tokens, seed, seed_tokens = [], 0, "", 0

    def flush() -> None:
        nonlocal held, tokens, seed, seed_tokens
        body, prefix = " ".join(held), 0
        if seed:
            bare = seed.rstrip()
            ended = seed if not bare or bare[-1] in T.TERMINATORS else bare + "."
            body, prefix = f"{ended} {body}", tok.count(ended)
        n = tok.count(body)
        out.append({"chunk_index": len(out), "text": body, "token_count": n, "start_token": 0, "end_token": n, "overlap_prefix_tokens": prefix})
        seed = tok.tail(body, overlap) if overlap > 0 else ""
        held, tokens, seed_tokens = [], 0, tok.count(seed)

    for i, s in enumerate(sentences):
        n = tok.count(s)
        if held and tokens + n + seed_tokens > size:
            flush()
        held.append(s)
        tokens += n
        if breaks[i] and i + 1 < len(sentences) and tokens + seed_tokens >= least:
            flush()
    if held:
        flush()
    return out


def _chunk_udf(chunker: Callable[[str | None], list[dict]]) -> Callable[[Column], Column]:
    # rows go one by one, a hundred in flight: an Arrow batch would hold the chunks of 10,000 texts
    return F.udf(chunker, CHUNKS, useArrow=False)


def chunk_with(df: DataFrame, strategy: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row a chunk by the named strategy: fixed, recursive or semantic."""
    if strategy == "fixed":
        return chunk_fixed(df, id_col, text, size, overlap).withColumn("overlap_prefix_tokens", F.lit(None).cast("int"))
    chunkers = {"recursive": lambda t: recursive_chunks(t, size, overlap), "semantic": lambda t: semantic_chunks(t, size=size, overlap=overlap)}
    if strategy not in chunkers:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    return df.select(id_col, F.explode(_chunk_udf(chunkers[strategy])(F.col(text))).alias("c")).select(id_col, "c.*")


def pick_strategy(batch_size: int, asked: str | None = None, default: str = "semantic", many: int = 100) -> str:
    """Batches of ``many`` files or more are chunked recursively whatever was asked."""
    return "recursive" if batch_size >= many else asked or default


#: Strategy of a language where texts come one by one, and that of any other (fixed values).
STRATEGIES = {"en": "recursive", "fr": "semantic", "ur": "semantic", "ko": "semantic", "ar": "semantic"}
OTHER_STRATEGY = "recursive"


def strategy_of(language: Column) -> Column:
    out = F.lit(OTHER_STRATEGY)
    for name, strategy in STRATEGIES.items():
        out = F.when(language == name, strategy).otherwise(out)
    return out


def chunk_by_strategy(df: DataFrame, strategy: str = "strategy", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of rows that each name their strategy, with the strategy beside them."""
    made = [chunk_with(df.filter(F.col(strategy) == s), s, id_col, text).withColumn("strategy", F.lit(s)) for s in ("fixed", "recursive", "semantic")]
    return made[0].unionByName(made[1]).unionByName(made[2])


def stem(filename: Column) -> Column:
    """A file's name without its folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.[^.]*$", "")


def rechunk(meta: DataFrame, texts: DataFrame, strategy: str, text: str = "text") -> DataFrame:
    """Chunks by another strategy of stored texts (filename, text), named by the metadata row with the same stem.

    A text whose stem no metadata row has is left out; of rows with one stem the first name counts.
    """
    named = meta.groupBy(stem(F.col("filename")).alias("stem")).agg(F.min("filename").alias("filename"))
    rows = texts.select(stem(F.col("filename")).alias("stem"), F.col(text).alias("text")).join(named, "stem")
    return chunk_with(rows, strategy, "filename").withColumn("strategy", F.lit(strategy))


def chunk_stats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: chunks, mean, median and population deviation of tokens, share that ends at a sentence end."""
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_chunks"),
        F.avg("token_count").alias("mean_tokens"),
        F.median("token_count").alias("median_tokens"),
        F.stddev_pop("token_count").alias("std_tokens"),
        F.round(F.avg(T.at_sentence_end(F.col("text")).cast("double")), 3).alias("boundary_quality"),
    )


def verify_chunks(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Per document: characters covered by chunks per character, largest chunk, and a status."""
    made = chunks.groupBy(id_col).agg(F.sum(F.length("text")).alias("chunk_chars"), F.max("token_count").alias("largest"))
    ratio = F.round(F.col("chunk_chars") / F.greatest(F.length(text), F.lit(1)), 4)
    status = F.when(F.col("largest") > 1.1 * size, "oversize").when(F.col("coverage") < 0.95, "low_coverage").when(F.col("coverage") > 3.0, "high_coverage").otherwise("ok")
    return docs.join(made, id_col).withColumn("coverage", ratio).select(id_col, "coverage", "largest", status.alias("status"))


def strip_leading(text: Column, n: Column) -> Column:
    """The text without its first ``n`` tokens; all of it for none."""
    rest = let(token_column(text), lambda t: F.array_join(F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0))), ""))
    return F.when(n > 0, rest).otherwise(text)


ENDS = "struct<total:double,pairs:int,first:array<double>,last:array<double>>"


def _ends(embed: Callable[[str], list[float]]) -> Callable[[Column, Column], Column]:
    """Of a chunk's sentences: sum and number of neighbour cosines, the vector of ``head`` and that of the last sentence."""

    def run(sentences: list[str] | None, head: str | None) -> tuple[float, int, list[float] | None, list[float] | None]:
        total, pairs, last, size = 0.0, 0, None, 0.0
        for s in sentences or []:
            v = embed(s)
            n = math.sqrt(math.sumprod(v, v))
            if last is not None:
                total, pairs = total + math.sumprod(last, v) / (size * n + 1e-10), pairs + 1
            last, size = v, n
        return total, pairs, None if head is None else embed(head), last

    return F.udf(run, ENDS, useArrow=False)


def coherence(chunks: DataFrame, embed: Callable[[str], list[float]] = hashed_embedding, id_col: str = "doc_id") -> DataFrame:
    """Per document: mean cosine of neighbouring sentences inside chunks, and across chunk ends.

    Across an end the last sentence of a chunk meets the first of the next one without its overlap prefix. A chunk is read once;
    the vectors of its two ends are all that is shuffled.
    """
    head = F.get(T.sentences(strip_leading(F.col("text"), F.coalesce("overlap_prefix_tokens", F.lit(0)))), 0)
    ends = chunks.select(id_col, "chunk_index", _ends(embed)(T.sentences(F.col("text")), head).alias("e")).select(id_col, "chunk_index", "e.*")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(id_col).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    met = ends.withColumn("before", before)
    across = F.when(F.col("before").isNotNull() & F.col("first").isNotNull(), dot("before", "first") / (norm("before") * norm("first") + 1e-10))
    return met.groupBy(id_col).agg((F.sum("total") / F.nullif(F.sum("pairs"), F.lit(0))).alias("avg_intra_similarity"), F.avg(across).alias("avg_boundary_similarity"))
