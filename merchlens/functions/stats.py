"""Small statistics written as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """E29. Wilson interval bounds; NULL when n is 0."""
    total = F.nullif(n, F.lit(0)).cast("double")
    p = successes / total
    z2 = z * z
    d = 1 + z2 / total
    center = (p + z2 / (2 * total)) / d
    margin = (z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))) / d
    return center - margin, center + margin


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    """Empty prediction is right only when nothing was expected."""
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise((fn == 0).cast("double"))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise((fp == 0).cast("double"))


def f1(tp: Column, fp: Column, fn: Column, empty: float | None = 1.0) -> Column:
    return F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(empty))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(part * 100.0 / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


# Digits that count in an exact mean.
DIGITS = 6


def units(value: Column) -> Column:
    """A value as a whole number of millionths, so that its sums do not depend on their order."""
    return F.round(value * float(10**DIGITS)).cast("bigint")


def exact_mean(total: Column, n: Column, digits: int = DIGITS) -> Column:
    """``total`` millionths over ``n`` rows, rounded once, half up; NULL when n is 0.

    All steps but the last division are in whole numbers, so any engine gives this value.
    """
    half = F.nullif(n.cast("bigint"), F.lit(0)) * 10 ** (DIGITS - digits)
    doubled = 2 * total + half
    whole = F.call_function("div", doubled - F.pmod(doubled, 2 * half), 2 * half)
    return whole.cast("double") / float(10**digits)


def exact_mean_sql(total: str, n: str, digits: int = DIGITS) -> str:
    """The same in DuckDB, for a total and a count."""
    half = f"({n}) * {10 ** (DIGITS - digits)}"
    doubled = f"(2 * ({total}) + {half})"
    step = f"nullif(2 * {half}, 0)"
    rest = f"((({doubled} % {step}) + {step}) % {step})"
    return f"(CAST(({doubled} - {rest}) // {step} AS DOUBLE) / {float(10**digits)!r})"


def units_sql(value: str) -> str:
    return f"CAST(round(({value}) * {float(10**DIGITS)!r}) AS BIGINT)"
