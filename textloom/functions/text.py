"""Text functions as column expressions. Regular expressions are Unicode-aware where the semantics are."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from textloom.functions.columns import let

SUPPORTED_LANGUAGES = ("en", "ur", "ar", "fr", "ko")
#: Placeholder titles that count as no title (fixed values).
PLACEHOLDER_TITLES = ("word document", "untitled", "")
#: Sentence terminators (fixed values).
TERMINATORS = ".!?۔؟！。"
HANGUL, ARABIC, LATIN = r"[\x{AC00}-\x{D7A3}]", r"[\x{0600}-\x{06FF}]", "[a-zA-Z]"
ARABIC_WIDE = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"


@F.udf(returnType=StringType(), useArrow=False)
def _nfkc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column) -> Column:
    """Unicode compatibility normal form; Spark has no built-in for it.

    Only texts beyond ASCII go to Python, and by rows: a hundred texts are there at once, an Arrow batch would hold 10,000.
    """
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def clean_text(text: Column, normalise: bool = True) -> Column:
    """Normal form, control characters, hyphenated line ends, blank lines, blanks, line ends, ends - in this order."""
    t = F.coalesce(text, F.lit(""))
    t = nfkc(t) if normalise else t
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t]]", "")
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]+(?=\n)", "")
    return strip(t)


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in the text once it is cleaned."""
    return F.contains(clean_text(text), phrase)


#: Unicode white space, what ``(?U)\s`` matches.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without white space at its ends; only the ends are looked at, which a regular expression does not do."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def hash_form(text: Column) -> Column:
    """The form that is hashed for exact duplicates: stripped, lower case, white space runs as one blank."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def exact_hash(text: Column) -> Column:
    return F.sha2(hash_form(text), 256)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def resolve_title(title: Column, filename: Column) -> Column:
    stem = F.translate(F.regexp_replace(filename, r"\.[^.]*$", ""), "_-", "  ")
    return F.when(title.isNull() | F.lower(F.trim(title)).isin(*PLACEHOLDER_TITLES), stem).otherwise(title)


def script_presence(text: Column) -> Column:
    """ko with any Hangul, else ur with any Arabic letter, else en."""
    return F.when(text.rlike(HANGUL), "ko").when(text.rlike(ARABIC), "ur").otherwise("en")


def script_majority(text: Column) -> Column:
    """ko or ur only with strictly more letters than each other script, else en."""
    h, a, n = (F.regexp_count(text, F.lit(p)) for p in (HANGUL, ARABIC, LATIN))
    return F.when((h > a) & (h > n), "ko").when((a > h) & (a > n), "ur").otherwise("en")


def ocr_script(text: Column) -> Column:
    """Pooled script vote that routes pages to an OCR engine: the largest of urd, kor, eng in this order; none is eng."""
    a, h, n = (F.regexp_count(text, F.lit(p)) for p in (ARABIC_WIDE, HANGUL, LATIN))
    top = F.greatest(a, h, n)
    return F.when(top == 0, "eng").when(a == top, "urd").when(h == top, "kor").otherwise("eng")


def tokens_en(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Sliding n-grams of the text without blanks; a shorter text is its own single n-gram.

    The text is cut into characters once, so the cost grows with its length and not with the square of it.
    """

    def of(chars: Column) -> Column:
        slide = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) < n, F.array(F.array_join(chars, ""))).otherwise(slide)

    return let(F.array_remove(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), ""), of)


def tokens_ko(text: Column) -> Column:
    """Hangul runs (in place of a morphological analyser) and character trigrams."""
    return F.concat(F.regexp_extract_all(text, F.lit(HANGUL + "+"), F.lit(0)), char_ngrams(text))


def tokens_ur(text: Column) -> Column:
    return let(nfkc(text), lambda t: F.concat(F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0)), char_ngrams(t)))


def tokens(text: Column, language: Column) -> Column:
    """Tokens by language: a given one decides by its prefix, null is detected by script presence."""
    lang = F.coalesce(language, script_presence(text))
    return F.when(lang.startswith("ko"), tokens_ko(text)).when(lang.startswith("ur"), tokens_ur(text)).otherwise(tokens_en(text))


def sentences(text: Column) -> Column:
    """Non-blank sentences, cut at white space after a terminator."""
    return F.filter(F.split(strip(text), rf"(?<=[{TERMINATORS}])(?U:\s)+"), lambda s: strip(s) != "")


def at_sentence_end(text: Column) -> Column:
    """Whether the text ends with a terminator, or with one of .!? and a quote."""
    return strip(text).rlike(r"(?:[.!?][\"']?|[۔؟！。])\z")


def terminated(text: Column) -> Column:
    """The text with a full stop after it unless it is blank or ends in a terminator."""
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    return F.when((bare == "") | bare.rlike(rf"[{TERMINATORS}]\z"), text).otherwise(F.concat(bare, F.lit(".")))


def alpha_ratio(text: Column) -> Column:
    """Letters per character that is not white space; 0 without any."""
    solid = F.regexp_count(text, F.lit(r"(?U)\S"))
    return F.when(solid == 0, 0.0).otherwise(F.regexp_count(text, F.lit(r"\p{L}")) / solid)


def cited(answer: Column) -> Column:
    """Distinct numbers of [n] markers, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def followup_parts(raw: Column, most: int = 3) -> Column:
    """(answer, followups) of a raw answer with an optional FOLLOWUPS: block."""
    at = F.instr(raw, "FOLLOWUPS:")
    tail = strip(F.substring(raw, at + F.lit(10), F.length(raw)))
    lines = F.transform(F.filter(F.split(tail, "\n"), lambda x: strip(x) != ""), lambda x: strip(F.regexp_replace(x, "^[- ]+|[- ]+$", "")))
    none = F.array().cast("array<string>")
    return F.struct(
        strip(F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw)).alias("answer"),
        F.when(at > 0, F.slice(lines, 1, most)).otherwise(none).alias("followups"),
    )


#: Substrings that mark a rewrite as a refusal (fixed values).
REFUSALS = ("cannot", "corpus doesn't", "corpus does not", "i don't have", "i'm unable", "no information", "not contain")
#: Substrings that make a short model answer invalid (fixed values).
INVALID_ANSWERS = ("user safety:", "i cannot assist", "i'm unable to help with that")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(text), F.lit(p))
    return out


def guarded_rewrite(raw: Column, rewritten: Column, most: int = 300) -> Column:
    """The rewritten query unless it reads like a refusal or is too long."""
    return F.when(any_of(rewritten, REFUSALS) | (F.length(rewritten) > most), raw).otherwise(rewritten)


def valid_answer(answer: Column) -> Column:
    return F.coalesce((F.length(strip(answer)) >= 3) & ~(any_of(answer, INVALID_ANSWERS) & (F.length(answer) < 60)), F.lit(False))


def verdict_field(raw: Column, field: str) -> Column:
    """True when ``FIELD: word`` starts with y, false for another word, null when the field is missing."""
    word = F.regexp_extract(raw, rf"(?iU){field}\s*:\s*(\w+)", 1)
    return F.when(word == "", None).otherwise(F.lower(word).startswith("y"))


def parse_lines(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, "\n"), strip), lambda x: x != "")


def query_variants(rewritten: Column, raw: Column, n: int = 3) -> Column:
    """The lines of a multi-query answer with the rewritten query first when it is not among them, at most n + 1."""
    lines = parse_lines(raw)
    return F.slice(F.when(F.array_contains(lines, rewritten), lines).otherwise(F.concat(F.array(rewritten), lines)), 1, n + 1)


def sub_queries(query: Column, raw: Column) -> Column:
    """SINGLE or no lines: the query itself; else the lines."""
    lines = parse_lines(raw)
    return F.when((F.upper(strip(raw)) == "SINGLE") | (F.size(lines) == 0), F.array(query)).otherwise(lines)


def repeats(text: Column, window: int = 40) -> Column:
    """Whether some window of characters occurs more than once without overlap; one pass over the text."""

    @F.pandas_udf(BooleanType())
    def again(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _comes_again(t, window))

    return again(text)


def _comes_again(text: str, window: int) -> bool:
    first: dict[int, int] = {}  # where a window's hash stood first
    for i in range(len(text) - window + 1):
        here = text[i : i + window]
        at = first.setdefault(hash(here), i)
        # windows of one hash are nearly always equal; if not, look where this one stood first
        if i - at >= window and (text.startswith(here, at) or text.find(here) <= i - window):
            return True
    return False
