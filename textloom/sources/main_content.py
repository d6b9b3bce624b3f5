"""Main content of a page by the densities of its blocks: a block of few words, or mostly links, between blocks of the same
kind is no content; a short block between long ones is, and so is a heading in front of content. All of it is row-local column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.columns import let

#: Elements whose text is never read, and elements that begin and end a block (fixed values).
SILENT = ("script", "style", "noscript", "template", "svg")
BLOCKS = ("p", "div", "li", "tr", "td", "th", "h[1-6]", "section", "article", "nav", "header", "footer", "aside", "main", "ul", "ol", "table", "title", "body", "html", "blockquote", "pre", "br", "hr", "form")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Content has so many words outside links, on average with its neighbours, and at most this share of links.
LEAST_WORDS, MOST_LINKS = 10.0, 0.5
#: Marks of the begin and end of a link, and of a heading, in a block's text.
OPEN, CLOSE, HEAD = "\x01", "\x02", "\x03"


def page_blocks(page: Column) -> Column:
    """array<struct<text, chars, links, words, heading>>: the blocks of a page that have text, in order.

    ``links`` counts the characters inside links; a link that goes on in the next block counts up to the block's end.
    """
    silent = "|".join(SILENT)
    t = F.regexp_replace(F.coalesce(page, F.lit("")), f"[{OPEN}{CLOSE}{HEAD}]", "")
    t = F.regexp_replace(t, rf"(?is)<!--.*?-->|<({silent})\b.*?</\1\s*>|<head\b.*?</head\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<a\b[^>]*>", OPEN), r"(?i)</a\s*>", CLOSE)
    t = F.regexp_replace(t, r"(?i)<h[1-6]\b[^>]*>", "\n" + HEAD)
    t = F.regexp_replace(t, rf"(?i)</?({'|'.join(BLOCKS)})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    lines = F.split(F.regexp_replace(t, r"[ \t\r]+", " "), "\n")

    def block(line: Column) -> Column:
        text = F.trim(F.regexp_replace(line, f"[{OPEN}{CLOSE}{HEAD}]", ""))
        linked = F.aggregate(F.regexp_extract_all(line, F.lit(f"{OPEN}[^{CLOSE}]*"), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x) - 1)
        return F.struct(text.alias("text"), F.length(text).alias("chars"), F.least(linked, F.length(text)).alias("links"), F.size(F.array_remove(F.split(text, " "), "")).alias("words"), F.contains(line, F.lit(HEAD)).alias("heading"))

    return F.filter(F.transform(lines, block), lambda b: b["chars"] > 0)


def kept_blocks(blocks: Column, least_words: float = LEAST_WORDS, most_links: float = MOST_LINKS) -> Column:
    """The blocks that are content."""
    weight = lambda b: F.coalesce(b["words"] * (b["chars"] - b["links"]) / b["chars"], F.lit(0.0))

    def keep(bs: Column) -> Column:
        smooth = lambda b, i: (weight(F.get(bs, i - 1)) + 2 * weight(b) + weight(F.get(bs, i + 1))) / 4
        few_links = lambda b: b["links"] <= most_links * b["chars"]
        dense = lambda b, i: few_links(b) & (smooth(b, i) >= least_words)
        behind = lambda i: F.coalesce(dense(F.get(bs, i + 1), i + 1), F.lit(False))
        return F.filter(bs, lambda b, i: dense(b, i) | (b["heading"] & few_links(b) & behind(i)))

    return let(blocks, keep)


def main_text(page: Column) -> Column:
    """The content's text, a line a block; null for a page without content."""
    text = F.array_join(F.transform(kept_blocks(page_blocks(page)), lambda b: b["text"]), "\n")
    return F.nullif(text, F.lit(""))
