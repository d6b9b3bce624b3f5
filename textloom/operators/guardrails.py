"""Guardrails as column expressions over rule tables, with pluggable classifiers.

A classifier is a function Column -> Column of a score from 0 to 1; without one its check never fires. A detector given
a language that it has no rules for matches nothing; without a language it tries all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T

Scorer = Callable[[Column], Column]
THRESHOLD = 0.5
QUERY_LANGUAGES = ("en", "ko", "ur")


def _hit(text: Column, pattern: str, flags: str = "U") -> Column:
    return F.coalesce(text.rlike(f"(?{flags}){pattern}"), F.lit(False))


def _applies(language: Column, lang: str) -> Column:
    return language.isNull() | (language == lang)


def exfiltration(text: Column, language: Column) -> Column:
    """Struct of category, pattern and language of the first rule that matches, or of nulls."""
    rows = [
        F.when(_applies(language, lang) & _hit(text, p, "iuU"), F.struct(F.lit(category).alias("category"), F.lit(p).alias("pattern"), F.lit(lang).alias("language")))
        for category, by_lang in rules.EXFILTRATION.items()
        for lang in rules.LANGUAGES
        for p in by_lang.get(lang, [])
    ]
    return F.coalesce(*rows)


def roleplay(text: Column, language: Column) -> Column:
    """Struct of pattern and language of the first roleplay rule that matches, or of nulls."""
    rows = [
        F.when(_applies(language, lang) & _hit(text, p, "iuU"), F.struct(F.lit(p).alias("pattern"), F.lit(lang).alias("language")))
        for lang in rules.LANGUAGES
        for p in rules.ROLEPLAY[lang]
    ]
    return F.coalesce(*rows)


def pii_entities(text: Column, language: Column, recogniser: Callable[[Column], Column] | None = None) -> Column:
    """Sorted distinct kinds of personal data. ``recogniser`` may add kinds for English."""
    lang = F.coalesce(language, F.lit("en"))
    found = [F.when(_hit(text, p) if wanted is None else (lang == wanted) & _hit(text, p), F.lit(kind)) for kind, wanted, p in rules.PII]
    kinds = F.array_compact(F.array(*found))
    if recogniser is not None:
        kinds = F.concat(kinds, F.when(lang == "en", recogniser(text)).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(kinds))


def toxicity(text: Column, language: Column, scorer: Scorer | None = None) -> Column:
    """Struct of is_toxic, source (model, regex, model+regex, none) and model_score."""
    score = scorer(text) if scorer else F.lit(0.0)
    by_rule = F.lit(False)
    for lang, patterns in rules.TOXIC.items():
        for p in patterns:
            by_rule = by_rule | ((language == lang) & _hit(text, p))
    by_rule, by_model = F.coalesce(by_rule, F.lit(False)), score >= THRESHOLD
    source = F.when(by_model & by_rule, "model+regex").when(by_rule, "regex").when(by_model, "model").otherwise("none")
    return F.struct((by_model | by_rule).alias("is_toxic"), source.alias("source"), F.round(score, 3).alias("model_score"))


def input_reasons(text: Column, language: Column, injection: Scorer | None = None, toxic: Scorer | None = None) -> Column:
    """Why an input is blocked, in fixed order; empty when it is not."""
    category = exfiltration(text, language)["category"]
    inject = (injection(text) >= THRESHOLD) if injection else F.lit(False)
    return F.array_compact(
        F.array(
            F.when(inject, F.lit("injection")),
            F.when(roleplay(text, language).isNotNull(), F.lit("jailbreak_roleplay")),
            F.when(category.isNotNull(), F.concat(F.lit("exfiltration:"), category)),
            F.when(toxicity(text, language, toxic)["is_toxic"], F.lit("toxicity")),
            F.when(F.size(pii_entities(text, language)) > 0, F.lit("pii_detected")),
        )
    )


def output_reasons(text: Column, language: Column) -> Column:
    category = exfiltration(text, language)["category"]
    return F.array_compact(F.array(F.when(category.isNotNull(), F.concat(F.lit("exfiltration:"), category)), F.when(F.size(pii_entities(text, language)) > 0, F.lit("pii_leak"))))


def check_input(df: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None, text: str = "text", language: str = "language", injection: Scorer | None = None, toxic: Scorer | None = None) -> DataFrame:
    """``df`` with reasons and blocked. ``judge`` adds a boolean column ``unsafe`` and only sees rows that passed so far."""
    fast = df.withColumn("reasons", input_reasons(F.col(text), F.col(language), injection, toxic)).withColumn("blocked", F.size("reasons") > 0)
    if judge is None:
        return fast
    asked = judge(fast.filter("NOT blocked"))
    late = asked.withColumn("reasons", F.when(F.col("unsafe"), F.array(F.lit("jailbreak_narrative_llm"))).otherwise(F.col("reasons"))).withColumn("blocked", F.col("unsafe")).drop("unsafe")
    return fast.filter("blocked").unionByName(late)


def check_output(df: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    return df.withColumn("reasons", output_reasons(F.col(text), F.col(language))).withColumn("blocked", F.size("reasons") > 0)


def is_unsafe(verdict: Column) -> Column:
    """A judge's answer blocks when it is UNSAFE."""
    return F.upper(T.strip(verdict)) == "UNSAFE"


def query_language(text: Column, detected: Column) -> Column:
    """Language of a query for routing: short or undetected texts are en, others must be supported or are ``unsupported``."""
    return F.when((F.length(T.strip(text)) < 20) | detected.isNull(), "en").when(detected.isin(*QUERY_LANGUAGES), detected).otherwise("unsupported")
