"""Document sources: binary files in, one row a document out. Native formats use the standard library only; PDF text and
OCR come from a provider, a function from bytes to (page, text, ocr_confidence) rows."""

from __future__ import annotations

import html as html_lib
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions import text as T

#: Suffix of each supported type (fixed values).
TYPES = {".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html"}
#: A page with less native text goes to OCR; pages below this confidence are reported.
OCR_BELOW, LOW_CONFIDENCE = 20, 60.0
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_type(path: Column) -> Column:
    """pdf, docx or html by the lower-cased suffix; null for anything else."""
    suffix = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    out = F.lit(None).cast("string")
    for s, kind in TYPES.items():
        out = F.when(suffix == s, kind).otherwise(out)
    return out


def discover(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, filename, file_type, length, content) of the files under a folder; unsupported ones have a null type."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), file_type(F.col("path")).alias("file_type"), "length", "content")


def docx_text(content: bytes) -> dict:
    """Non-blank paragraphs, then table rows as ``cell | cell``, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    paragraphs = [s for p in body.findall(f"{_WORD}p") if (s := said(p)).strip()]
    tables = body.findall(f"{_WORD}tbl")
    rows = [" | ".join("\n".join(said(p) for p in c.findall(f"{_WORD}p")).strip() for c in r.findall(f"{_WORD}tc")) for t in tables for r in t.findall(f"{_WORD}tr")]
    rows = [r for r in rows if r.replace("|", "").strip()]
    return {"text": "\n\n".join(paragraphs + rows), "paragraph_count": len(paragraphs), "table_count": len(tables)}


_CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "created": "{http://purl.org/dc/terms/}created"}
PROPERTIES = StructType([StructField(name, StringType()) for name in _CORE])


def docx_core(content: bytes) -> dict[str, str | None]:
    """Title, author and date of a document's core properties, null where missing or empty."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("docProps/core.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return dict.fromkeys(_CORE)
    return {name: (root.findtext(tag) or "").strip() or None for name, tag in _CORE.items()}


@F.pandas_udf(PROPERTIES)
def docx_properties(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([docx_core(c) if c is not None else dict.fromkeys(_CORE) for c in contents], columns=list(_CORE))


def native_properties(files: DataFrame) -> DataFrame:
    """(path, title, author, created) of HTML pages and DOCX documents; nulls for other files."""
    page, html = F.col("content").cast("string"), F.col("file_type") == "html"
    core = files.filter("file_type = 'docx'").select("path", docx_properties("content").alias("p")).select("path", "p.*")
    rest = files.filter("file_type IS NULL OR file_type <> 'docx'")
    tags = [F.when(html, c).alias(name) for name, c in (("title", html_title(page)), ("author", html_meta(page, "author")), ("created", html_meta(page, "date")))]
    return core.unionByName(rest.select("path", *tags))


def docx_file(paragraphs: list[str]) -> bytes:
    """A minimal document of paragraphs, for tests and exports."""
    body = "".join(f"<w:p><w:r><w:t>{html_lib.escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@F.pandas_udf(StringType())
def _docx(contents: pd.Series) -> pd.Series:
    def one(content: bytes) -> str | None:
        try:
            return docx_text(content)["text"]
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
            return None

    return contents.map(one)


def html_text(page: Column) -> Column:
    """Main text of a page: scripts, styles, navigation and tags go, block ends become line ends, entities are resolved."""
    t = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|noscript|template|svg)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<head\b.*?</head\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|title|ul|ol|table)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")
    return T.strip(t)


def html_title(page: Column) -> Column:
    title = T.strip(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title != "", title)


def html_meta(page: Column, name: str) -> Column:
    """Content of a meta tag, null when it is missing or empty."""
    found = F.regexp_extract(page, rf"(?is)<meta\s+(?:name|property)=[\"']{name}[\"']\s+content=[\"']([^\"']*)[\"']", 1)
    return F.when(found != "", found)


def join_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, text, extraction) from (key, page, text, ocr_confidence, error) rows: pages in order, blank ones skipped."""
    row = F.struct("page", "text", "ocr_confidence", "error")
    all_ = pages.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("p"))
    ocr = F.filter("p", lambda x: x["ocr_confidence"].isNotNull())
    return all_.select(
        key,
        F.array_join(F.filter(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), lambda t: T.strip(t) != ""), "\n\n").alias("text"),
        F.size("p").alias("page_count"),
        F.transform(ocr, lambda x: x["page"]).alias("ocr_pages"),
        F.map_from_entries(F.transform(ocr, lambda x: F.struct(x["page"].alias("key"), x["ocr_confidence"].alias("value")))).alias("ocr_confidence"),
        F.transform(F.filter(ocr, lambda x: x["ocr_confidence"] < LOW_CONFIDENCE), lambda x: x["page"]).alias("low_confidence_pages"),
        F.transform(F.filter("p", lambda x: x["error"].isNotNull()), lambda x: F.struct(x["page"].alias("page"), x["error"].alias("error"))).alias("failed_pages"),
    )


def needs_ocr(page_text: Column) -> Column:
    return F.length(T.strip(F.coalesce(page_text, F.lit("")))) < OCR_BELOW


def ocr_lines(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, text) from OCR words (key, seq, block, par, line, word): words in order, lines in order of their first word."""
    line = words.groupBy(*key, "block", "par", "line").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "word"))).alias("w"))
    line = line.select(*key, "first", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("t"))
    return line.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "t"))), lambda x: x["t"]), "\n").alias("text"))


def ocr_confidence(confidences: Column) -> Column:
    """Mean of the confidences that are not -1, to one place; 0 when there is none."""
    used = F.filter(confidences, lambda c: c != -1)
    return F.when(F.size(used) == 0, 0.0).otherwise(F.round(F.aggregate(used, F.lit(0.0), lambda t, x: t + x) / F.size(used), 1))


def ingest(files: DataFrame, pdf: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): path, filename, file_type, text of supported files; the others with a reason.

    ``pdf`` maps (path, content) rows to page rows for ``join_pages``; without it PDF files are rejected.
    """
    page = F.col("content").cast("string")
    html = files.filter("file_type = 'html'").select("path", "filename", "file_type", html_text(page).alias("text"))
    docx = files.filter("file_type = 'docx'").select("path", "filename", "file_type", _docx("content").alias("text"))
    done = html.unionByName(docx)
    if pdf is not None:
        pdfs = files.filter("file_type = 'pdf'")
        done = done.unionByName(pdfs.select("path", "filename", "file_type").join(join_pages(pdf(pdfs.select("path", "content"))).select("path", "text"), "path"))
    bad = files.filter("file_type IS NULL" + ("" if pdf else " OR file_type = 'pdf'")).select("path", "filename", F.lit("unsupported file type").alias("error"))
    return done.filter("text IS NOT NULL"), bad.union(done.filter("text IS NULL").select("path", "filename", F.lit("unreadable file").alias("error")))


def validation_report(documents: DataFrame, rejects: DataFrame) -> DataFrame:
    """(filename, status, error, char_count, word_count): ok, warning_empty_text or error."""
    cleaned = T.clean_text(F.col("text"))
    ok = documents.withColumn("_c", cleaned).select("filename", F.when(F.length("_c") == 0, "warning_empty_text").otherwise("ok").alias("status"), F.lit("").alias("error"), F.length("_c").alias("char_count"), T.word_count(F.col("_c")).alias("word_count"))
    return ok.union(rejects.select("filename", F.lit("error"), "error", F.lit(0), F.lit(0)))
