"""Models behind small interfaces, with deterministic stand-ins. A stand-in keeps plumbing testable; its scores are not a model's."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textloom.functions import text as T

#: Text put before passages and questions for models that expect it (fixed values).
PREFIXES = {"bge-large": ("", ""), "bge-m3": ("", ""), "e5-large": ("passage: ", "query: "), "multilingual-e5-large": ("passage: ", "query: ")}

#: Instructions of models that embed (instruction, text) pairs, for passages and for questions (fixed values).
INSTRUCTIONS = {"instructor-xl": ("Represent the document for retrieval:", "Represent the question for retrieving supporting documents:")}


def embed_pairs(texts: Column, model: str, run: Callable[[Column, Column], Column], question: bool = False) -> Column:
    """Vectors of a model that takes the instruction and the text as a pair: ``run`` gets two columns."""
    return run(F.lit(INSTRUCTIONS[model][int(question)]), texts)


def embedder(dim: int = 64, embed: Callable[[str], list[float]] | None = None) -> Callable[[Column], Column]:
    """Column function of unit vectors; by default hashed words."""
    from textloom.operators.chunking import hashed_embedding

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        one = embed or (lambda t: hashed_embedding(t, dim))
        return texts.map(lambda t: one(t or ""))

    return run


def embed_passages(text: Column, model: str, run: Callable[[Column], Column]) -> Column:
    return run(F.concat(F.lit(PREFIXES.get(model, ("", ""))[0]), text))


def embed_questions(text: Column, model: str, run: Callable[[Column], Column]) -> Column:
    return run(F.concat(F.lit(PREFIXES.get(model, ("", ""))[1]), text))


def overlap_score(question: Column, passage: Column) -> Column:
    """Stand-in reranker: share of the question's distinct tokens that the passage holds."""
    asked = F.array_distinct(T.tokens_en(question))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, T.tokens_en(passage))) / F.size(asked))


def extractive_answer(question: Column, context: Column) -> Column:
    """Stand-in generator: the first passage's first sentence with its mark."""
    first = F.get(F.split(context, "\n", 3), 1)
    return F.concat(F.coalesce(F.get(T.sentences(first), 0), F.lit("")), F.lit(" [1]\nFOLLOWUPS:\n- "), question)


def same(question: Column, *_: Column) -> Column:
    """Stand-in rewriter."""
    return question


#: Function words that tell the languages of the stand-in detector apart (fixed values).
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was"),
    "fr": ("le", "la", "les", "et", "des", "un", "une", "que", "pour", "dans"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "zu", "mit", "den"),
    "es": ("el", "los", "las", "que", "del", "una", "por", "con", "para", "y"),
}


def detect_languages(text: Column, least: float = 0.10) -> Column:
    """Array of (language, probability to 4 places), likeliest first, at ``least`` or above; null below 50 characters.

    Scripts decide for Korean and Urdu; function words share the rest out.
    """
    tokens = T.tokens_en(text)
    counts = [_count(tokens, ws) for ws in FUNCTION_WORDS.values()]
    counts += [F.regexp_count(text, F.lit(T.HANGUL)), F.regexp_count(text, F.lit(T.ARABIC))]
    total = sum(counts[1:], counts[0])
    rows = [F.struct((-F.round(c / total, 4)).alias("order"), F.lit(name).alias("language")) for name, c in zip([*FUNCTION_WORDS, "ko", "ur"], counts, strict=True)]
    kept = F.filter(F.array_sort(F.array(*rows)), lambda r: -r["order"] >= least)
    found = F.transform(kept, lambda r: F.struct(r["language"].alias("language"), (-r["order"]).alias("probability")))
    return F.when(F.length(T.strip(text)) < 50, None).when(total == 0, F.array().cast("array<struct<language:string,probability:double>>")).otherwise(found)


def _count(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*words)))


def primary_language(languages: Column) -> Column:
    return F.try_element_at(languages, F.lit(1))["language"]


def is_supported(languages: Column) -> Column:
    return F.coalesce(primary_language(languages).isin(*T.SUPPORTED_LANGUAGES), F.lit(False))
