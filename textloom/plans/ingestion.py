"""Ingestion of a batch of files: extract, clean, profile, find duplicates, chunk. One plan for the whole batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import providers
from textloom.functions import text as T
from textloom.operators import chunking as C
from textloom.operators import dedup as D
from textloom.sources import files as S


@dataclass
class Batch:
    """documents (filename, text), metadata (one row a file), chunks and rejects."""

    documents: DataFrame
    metadata: DataFrame
    chunks: DataFrame
    rejects: DataFrame


def ingest_batch(files: DataFrame, existing: DataFrame | None = None, strategy: str | None = None, pdf=None) -> Batch:
    """files: rows of ``sources.files.discover``; existing: (filename, text) of documents stored before.

    A file is a duplicate of the first stored document with the same text, else of the most similar one; it is never
    compared with the stored version of itself. Batches of 100 files or more are chunked recursively.
    """
    raw, rejects = S.ingest(files, pdf)
    docs = raw.withColumn("text", T.clean_text(F.col("text")))
    chosen = C.pick_strategy(files.count(), strategy)
    native = files.select("path", "length").join(S.native_properties(files), "path")
    languages = providers.detect_languages(F.col("text"))
    meta = docs.join(native, "path").select(
        "filename", "file_type", T.resolve_title(F.col("title"), F.col("filename")).alias("title"), "author", "created", F.col("length").alias("file_size_bytes"),
        F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"), languages.alias("languages"), F.lit(chosen).alias("chunking_strategy_used"),
    )
    meta = meta.withColumns({"primary_language": providers.primary_language(F.col("languages")), "is_supported_language": providers.is_supported(F.col("languages"))})
    meta = with_duplicates(meta, docs, existing)
    return Batch(docs.select("filename", "text"), meta, C.chunk_with(docs, chosen, "filename"), rejects)


def ingest_texts(texts: DataFrame, existing: DataFrame | None = None, via: str = "ocr_text", detect=providers.detect_languages) -> Batch:
    """Texts that OCR made elsewhere (filename of the text, text, ocr_confidence) as documents of the files they come from.

    The original name has the suffix .pdf; each text is chunked by its language's strategy; a blank text is a reject.
    """
    named = texts.select(F.concat(C.stem(F.col("filename")), F.lit(".pdf")).alias("filename"), T.clean_text(F.col("text")).alias("text"), "ocr_confidence")
    docs = named.filter(T.strip(F.col("text")) != "").withColumn("languages", detect(F.col("text")))
    docs = docs.withColumn("primary_language", providers.primary_language(F.col("languages"))).withColumn("strategy", C.strategy_of(F.col("primary_language")))
    meta = docs.select("filename", F.lit("pdf").alias("file_type"), T.resolve_title(F.lit(None).cast("string"), F.col("filename")).alias("title"), F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"),
        "languages", "primary_language", providers.is_supported(F.col("languages")).alias("is_supported_language"), F.col("strategy").alias("chunking_strategy_used"), "ocr_confidence", F.lit(via).alias("ingested_via"))
    meta = with_duplicates(meta, docs, existing)
    rejects = named.filter(F.coalesce(T.strip(F.col("text")), F.lit("")) == "").select(F.col("filename").alias("path"), "filename", F.lit("empty text").alias("error"))
    return Batch(docs.select("filename", "text"), meta, C.chunk_by_strategy(docs, "strategy", "filename"), rejects)


def with_duplicates(meta: DataFrame, docs: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Metadata with is_duplicate and duplicate_of: against stored documents of other names."""
    if existing is None:
        return meta.withColumns({"is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("struct<filename:string,similarity:double>")})
    others = existing.join(docs.select("filename"), "filename", "left_anti")
    named = D.duplicate_of(docs.filter(T.strip(F.col("text")) != ""), others, "filename")
    of = F.when(F.col("duplicate_of").isNotNull(), F.struct(F.col("duplicate_of").alias("filename"), "similarity"))
    return meta.join(named.select(F.col("id").alias("filename"), of.alias("duplicate_of")), "filename", "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
