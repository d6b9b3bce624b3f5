"""Quality rules with cross-document line frequency (operator 4), in DataFrame functions only.

Lines are normalised (lower case, digits to 0, white space collapsed) and hashed. For each host the number of
distinct documents that hold a line is counted; exact copies of a text count as one document, so a clean text
is not lost because it was copied. Lines above the host's limit are removed, and a document that has lost most
of its words is rejected, as is one that fails the base rules.

Scale: text never leaves its scan. Only (host, line hash, text hash) triples, then (document, line hash) pairs
and per-document sums are shuffled; every count is pre-aggregated, and no line, host or document is gathered.

Defined results: a null text counts as empty and fails the base rules; a null host is a host of its own; a
document of any length is processed whole; repeated rows, and rows with equal ids and other texts or hosts, are judged
each by its own lines, without an id too; an empty table gives an empty result; extra columns are ignored by ``judge``
and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, let, packed, unpacked, words

#: A line is boilerplate in a host when more than this share of its distinct documents hold it,
HOST_SHARE = 0.01
#: but not with so few documents, and always above so many, however large the host is.
MIN_DOCS = 20
MAX_DOCS = 200
#: A document is depleted when at most this share of its words is left.
LEFT_SHARE = 0.5
WINDOW = 5


def _covered(hashes: Column, width: int) -> Column:
    """How many word places lie in windows whose hash occurs twice or more."""

    def spread(places: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(places) - 1),
            F.lit(width),
            lambda total, k: total + F.least(F.lit(width), F.get(places, k) - F.get(places, k - 1)),
        )

    def twice(pairs: Column) -> Column:
        hit = F.filter(
            F.sequence(F.lit(0), F.size(pairs) - 1),
            lambda k: F.get(pairs, k)["h"].eqNullSafe(F.get(pairs, k + 1)["h"]) | F.get(pairs, k)["h"].eqNullSafe(F.get(pairs, k - 1)["h"]),
        )
        return F.sort_array(F.transform(hit, lambda k: F.get(pairs, k)["p"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    return let(pairs, lambda s: let(twice(s), spread))


def repeat_words(word_array: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found at two or more places of the text."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, width)))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(counted)

    return let(word_array, of).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), f"[{SPACE}]+", " "))


def base_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the per-document base counts and ``base_failed``; purely row-local."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = words(t)
    measures = let(
        w,
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.coalesce(F.length(F.array_join(ws, "")), F.lit(0)).cast("long").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words"),
        ),
    )
    out = df.withColumn("_m", measures)
    out = out.withColumns(
        {
            "n_words": F.col("_m.n_words"),
            "word_chars": F.col("_m.word_chars"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": let(_lines(t), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": F.col("_m.n_repeat_words"),
        }
    ).drop("_m")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def line_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per line with a word: its document (id, host, hash of the text, number of the row), its hash and words."""
    line = F.transform(
        _lines(F.col(text)),
        lambda ln: F.struct(F.xxhash64(normal_line(ln)).alias("h"), F.size(words(ln)).alias("w")),
    )
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(text).alias("content"), F.monotonically_increasing_id().alias("row"), line.alias("_l"))
    return rows.select("doc_id", "host", "content", "row", F.explode("_l").alias("_l")).select("doc_id", "host", "content", "row", F.col("_l.h").alias("line"), F.col("_l.w").alias("w"))


def boilerplate(lines: DataFrame, texts: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line) of lines held by more distinct documents of the host than its limit allows.

    Copies of a text are one document: they are removed by a distinct over (host, line, content) first, which
    combines on the map side. ``texts`` has the (host, content) of every document.
    """
    held = lines.select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > min_docs)
    hosts = texts.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.least(F.lit(float(max_docs)), F.col("host_docs") * host_share))
    return held.join(hosts, held["host"].eqNullSafe(hosts["host"])).filter(F.col("docs") > limit).select(held["host"], "line")


def _hits(df: DataFrame, doc_id: str, text: str, host: str, min_docs: int, host_share: float, max_docs: int) -> DataFrame:
    """The rows of ``line_table`` that are boilerplate."""
    lines = line_table(df, doc_id, text, host)
    common = boilerplate(lines, df.select(F.col(host).alias("host"), F.xxhash64(text).alias("content")), min_docs, host_share, max_docs)
    named = common.select(F.col("host").alias("c_host"), F.col("line").alias("c_line"))
    return lines.join(named, (F.col("line") == F.col("c_line")) & F.col("host").eqNullSafe(F.col("c_host")), "left_semi")


#: What tells a document's rows apart; rows that agree in all three have the same lines.
_KEY = ("doc_id", "host", "content")


def _beside(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df`` with the columns of ``found`` for the same document, null ids and hosts included."""
    found = found.withColumnsRenamed({c: f"_{c}" for c in _KEY})
    same = (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("host").eqNullSafe(F.col("_host"))
    return df.join(found, same, "left").drop(*(f"_{c}" for c in _KEY))


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, left_share: float = LEFT_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document: base counts, words and lines lost to line frequency, ``depleted`` and ``kept``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"), F.xxhash64(text).alias("content"))
    base = base_metrics(rows, "text").drop("text")
    hit = _hits(df, doc_id, text, host, min_docs, host_share, max_docs)
    # first by row, so that a repeated row's lines are not added up
    lost = hit.groupBy(*_KEY, "row").agg(F.sum("w").cast("long").alias("words"), F.count(F.lit(1)).alias("lines"))
    lost = lost.groupBy(*_KEY).agg(F.max("words").alias("lost_words"), F.max("lines").alias("lost_lines"))
    out = _beside(base, lost).drop("host", "content").fillna(0, ["lost_words", "lost_lines"])
    out = out.withColumn("depleted", (F.col("lost_words") > 0) & (F.col("n_words") - F.col("lost_words") <= left_share * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, left_share: float = LEFT_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``df`` that pass, without the boilerplate lines; all columns stay, ``n_chars`` is renewed.

    The base rules and the share of words left are taken in one pass over the text once the boilerplate lines
    that a document holds are known; only documents that hold some get an array of their hashes.
    """
    rows = packed(df, doc_id=doc_id, text=text, host=host)
    drop = _hits(rows, "doc_id", "text", "host", min_docs, host_share, max_docs).groupBy(*_KEY).agg(F.collect_set("line").alias("drop"))
    sound = base_metrics(rows).filter(~F.col("base_failed")).select("_row", "doc_id", "host", "text", F.xxhash64("text").alias("content"), "n_words")
    out = _beside(sound, drop)
    left = F.array_join(F.filter(F.split("text", "\n"), lambda ln: ~F.array_contains(F.col("drop"), F.xxhash64(normal_line(ln)))), "\n")
    out = out.withColumn("left", F.when(F.col("drop").isNull(), F.col("text")).otherwise(left))
    out = out.filter(F.col("drop").isNull() | (F.size(words(F.col("left"))) > left_share * F.col("n_words")))
    changed = {text: F.col("left")}
    if "n_chars" in df.columns and text != "n_chars":
        changed["n_chars"] = F.length("left").cast(df.schema["n_chars"].dataType)
    return unpacked(out, df.columns, **changed)
