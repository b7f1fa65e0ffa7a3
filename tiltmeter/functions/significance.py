"""Tail probabilities of the normal distribution out of built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_LIMIT = 2.0
SERIES_TERMS = 40
ANGLES = 80


def two_sided_p(z: Column) -> Column:
    """P(|N(0,1)| >= |z|).

    For small |z| one minus the power series of erf. Beyond that Craig's integral of
    exp(-z^2 / (2 sin^2 t)) over a quarter turn by the midpoint rule, which keeps the relative
    precision in the tail.
    """
    size = F.abs(z)
    half_square = size * size / 2
    # erf(x) = 2/sqrt(pi) * exp(-x^2) * sum_k 2^k x^(2k+1) / (2k+1)!!
    x = size / math.sqrt(2.0)
    start = F.struct((x + F.lit(0.0)).alias("term"), (x + F.lit(0.0)).alias("sum"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        start,
        lambda s, k: F.struct(
            (s["term"] * 2 * half_square / (2 * k + 1)).alias("term"),
            (s["sum"] + s["term"] * 2 * half_square / (2 * k + 1)).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    small = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-half_square) * series
    squares = F.array(*[F.lit(math.sin((i + 0.5) * math.pi / (2 * ANGLES)) ** 2) for i in range(ANGLES)])
    tail = F.aggregate(squares, F.lit(0.0), lambda s, v: s + F.exp(-half_square / v)) / ANGLES
    return F.when(z.isNull(), F.lit(None)).when(size < SERIES_LIMIT, small).otherwise(tail)


def chi_square_p(statistic: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return two_sided_p(F.sqrt(statistic))
