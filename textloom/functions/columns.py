"""Column idioms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body`` (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two numeric arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def rounded(value: Column, places: int) -> Column:
    """A double rounded as DuckDB does it: scaled, rounded half away from zero, scaled back. ``F.round`` goes by the decimal
    digits instead: 41 / 640 = 0.0640625 is 0.064063 to it, but 0.0640625 * 1e6 is less than 64062.5."""
    return F.round(value * 10.0**places) / 10.0**places
