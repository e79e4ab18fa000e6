"""Single-precision scoring arithmetic.

Spark keeps FLOAT+FLOAT and FLOAT*FLOAT in FLOAT but divides in DOUBLE, so
quotients are rounded back to FLOAT once and sums are written out with ``+``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value: float) -> Column:
    return F.lit(float(value)).cast("float")


def tiers(*steps: tuple[Column, float]) -> Column:
    """Value of the first step whose condition holds, else 0."""
    expr = None
    for condition, value in steps:
        expr = F.when(condition, f32(value)) if expr is None else expr.when(condition, f32(value))
    return expr.otherwise(f32(0))


def add(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def share(total: Column, parts: int) -> Column:
    return F.least((total / F.lit(parts)).cast("float"), f32(1))


def ladder(value: Column, steps: list[tuple[float, str]], default: str, inclusive: bool = False) -> Column:
    """Name of the first cutoff that ``value`` passes."""
    expr = None
    for cutoff, name in steps:
        hit = value >= f32(cutoff) if inclusive else value > f32(cutoff)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(default)


def by_count(n: Column, steps: list[tuple[int, float]], default: float) -> Column:
    expr = None
    for least, value in steps:
        expr = F.when(n >= least, f32(value)) if expr is None else expr.when(n >= least, f32(value))
    return expr.otherwise(f32(default))


def evidence_list(*items: tuple[Column, Column | str, Column | None]) -> Column:
    """Entries whose condition holds, in order."""
    entries = []
    for condition, description, detail in items:
        text = F.lit(description) if isinstance(description, str) else description
        note = F.lit(None).cast("string") if detail is None else detail.cast("string")
        entries.append(F.when(condition, F.struct(text.alias("description"), note.alias("detail"))))
    return F.array_compact(F.array(*entries))
