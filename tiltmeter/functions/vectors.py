"""Dot products, norms and distances of ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; NaN if either vector is all zeros.

    One root of both squared lengths, so that equal vectors have exactly 1 and copies tie, as they do in SQL engines.
    """

    def length(squares: Column) -> Column:
        in_range = (squares > 0) & (squares < F.lit(float("inf")))
        return F.when(in_range, F.sqrt(squares)).otherwise(norm(a) * norm(b))

    def ratio(long: Column) -> Column:
        clipped = bound(dot(a, b) / long, lambda c: F.when(F.abs(c) <= 1, c).otherwise(F.signum(c)))
        return F.when(long == 0, F.lit(float("nan"))).otherwise(clipped)

    return bound(bound(dot(a, a) * dot(b, b), length), ratio)


def mean_squared_error(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def absolute_max(a: Column) -> Column:
    return F.greatest(F.array_max(a), -F.array_min(a))


def moments(values: Column) -> Column:
    """struct(n, mean, m2, m4) of the central moments, as sums."""
    n = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n

    def spread(s: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("m2"), F.lit(0.0).alias("m4"))
        return F.aggregate(
            s["v"],
            start,
            lambda acc, v: F.struct(
                (acc["m2"] + (v - s["mean"]) * (v - s["mean"])).alias("m2"),
                (acc["m4"] + F.pow(v - s["mean"], F.lit(4.0))).alias("m4"),
            ),
            lambda acc: F.struct(
                s["n"].alias("n"), s["mean"].alias("mean"), acc["m2"].alias("m2"), acc["m4"].alias("m4")
            ),
        )

    packed = F.array(F.struct(values.alias("v"), n.alias("n"), mean.alias("mean")))
    return F.get(F.transform(packed, spread), F.lit(0))


def kurtosis(values: Column) -> Column:
    """Mean fourth power of the scores standardised with the sample deviation (n - 1), without the -3."""
    m = moments(values)
    variance = m["m2"] / (m["n"] - 1)
    return m["m4"] / m["n"] / (variance * variance)
