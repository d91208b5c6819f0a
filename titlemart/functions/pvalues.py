"""Two-sided p-values of normal and Student variables, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series below ``NEAR`` and of the fraction from there on: the next ones no longer change a double.
SERIES, FRACTION, NEAR = 80, 60, 3.0


def _steps(n: int | Column, first: int = 1) -> Column:
    """1 to n, or none."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= first, F.sequence(F.lit(first), F.greatest(n, F.lit(first)).cast("int"))).otherwise(F.array().cast("array<int>"))


def _last_of(x: Column, of) -> Column:
    """``of(x)`` with x bound to a name, so that it is worked out once."""
    return F.element_at(F.transform(F.array(x), of), 1)


def _upper_tails(x: Column) -> Column:
    """erfc(x) of x >= 0: the power series of erf near 0, the continued fraction of erfc beyond."""
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * (2 * x * x / (2 * k + 1))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * F.aggregate(_steps(SERIES), start, add, lambda s: s["sum"])
    below = F.aggregate(F.reverse(_steps(FRACTION)), x, lambda s, k: x + k / 2 / s)
    return F.when(x < NEAR, near).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / below)


def normal_two_sided(z: Column | str) -> Column:
    """The probability of a normal variable at least as far from 0 as ``z``."""
    z = F.col(z) if isinstance(z, str) else z
    return F.when(F.abs(z) == float("inf"), 0.0).otherwise(_last_of(F.abs(z).cast("double") / math.sqrt(2), _upper_tails))


def student_two_sided(t: Column | str, df: Column | str) -> Column:
    """The probability of a Student variable at least as far from 0 as ``t``, for a whole number of degrees of freedom from 1: a finite sum in the angle whose tangent is t / sqrt(df)."""
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))

    def of(angle: Column) -> Column:
        cos2 = F.cos(angle) * F.cos(angle)
        odd = df % 2

        def add(s: Column, k: Column) -> Column:
            # Even: 1/2, 3/4, 5/6 ...; odd: 2/3, 4/5, 6/7 ...
            term = s["term"] * cos2 * (2 * k - 1 + odd) / (2 * k + odd)
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        total = F.aggregate(_steps(F.floor((df - 2 - odd) / 2)), one, add, lambda s: s["sum"])
        inner = F.when(df == 1, 2 / math.pi * angle).when(odd == 1, 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
        return F.greatest(F.lit(0.0), 1 - inner)

    return F.when(F.abs(t) == float("inf"), 0.0).otherwise(_last_of(F.atan(F.abs(t).cast("double") / F.sqrt(df)), of))
