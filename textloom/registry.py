"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text", "dedup", "chunks", "lexical", "vectors", "entities", "guardrails", "metrics", "answers", "datasets", "ingest", "surface", "upkeep")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with equivalent SQL where there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"textloom.queries.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best fixed-size chunks of the deduplicated corpus for each benchmark text, by BM25."""
    _load()
    return _QUERIES["bm25_chunk_topk"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows that a statement makes from given tables, named as ``{table}``; it reads the same on both engines."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The statement of ``derived`` for the SQL side."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def literal(value: object) -> str:
    """A SQL literal of a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """``(VALUES ...) t(columns)`` of a small fixture, for the SQL side."""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(VALUES {body}) t({', '.join(columns)})"
