"""Comparison of two samples: summaries, effect size, Mann–Whitney and chi-square tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.significance import chi_square_p, two_sided_p
from tiltmeter.operators.ordered import running_total, value_bucket, value_cuts
from tiltmeter.session import settle

def value_counts(df: DataFrame, groups: Sequence[str], value: str, second: Column) -> DataFrame:
    """Rows per distinct value and sample. Repeated values collapse before they are ordered.

    Missing values are dropped by their count: a filter on the value itself would be pushed down and
    work out the value a second time.
    """
    known = F.col(value).isNotNull()
    counts = df.groupBy(*groups, value).agg(
        F.count_if(~second & known).alias("n1"), F.count_if(second & known).alias("n2")
    )
    return counts.where(F.col("n1") + F.col("n2") > 0)


def mann_whitney(df: DataFrame, groups: Sequence[str], value: str, second: Column, exact: bool = False) -> DataFrame:
    """Two-sided Mann–Whitney U of the first against the second sample, per group.

    ``u`` is the statistic of the first sample. The p-value is the normal approximation with tie and continuity
    correction. ``exact`` asks for the exact one of small samples; groups with ties keep the approximation.
    """
    groups = list(groups)
    return rank_test(settle(value_counts(df, groups, value, second)), groups, value, exact)


def rank_test(counts: DataFrame, groups: Sequence[str], value: str, exact: bool = False) -> DataFrame:
    """The test of :func:`mann_whitney` from (groups, value, n1, n2)."""
    groups = list(groups)
    cuts = value_cuts(counts, value)
    placed = running_total(
        counts, groups, [F.col(value)], F.col("n1"), value_bucket(F.col(value), cuts), "_before"
    )
    # Cubes of counts leave the range of integers long before they leave that of doubles.
    t = (F.col("n1") + F.col("n2")).cast("double")
    # Every value of the second sample beats the earlier ones of the first and half of its equals.
    beaten = F.col("n2") * (F.col("_before") + F.col("n1") / F.lit(2.0))
    sums = placed.groupBy(*groups).agg(
        F.sum("n1").alias("n1"),
        F.sum("n2").alias("n2"),
        F.sum(beaten).alias("u2"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    larger = F.greatest(F.col("u1"), F.col("u2"))
    scored = (
        sums.where((F.col("n1") > 0) & (F.col("n2") > 0))
        .withColumn("u1", n1 * n2 - F.col("u2"))
        .withColumn("z", F.try_divide(larger - n1 * n2 / 2 - 0.5, spread))
    )
    normal = F.when(F.col("z") < 0, F.lit(1.0)).otherwise(two_sided_p(F.col("z")))
    if exact:
        untied = F.col("ties") == 0
        normal = F.coalesce(exact_p(*[F.when(untied, c) for c in (F.col("n1"), F.col("n2"), larger)]), normal)
    return scored.withColumn("p_value", normal).select(
        *groups, "n1", "n2", F.col("u1").alias("u"), "z", "p_value"
    )


def exact_tail(n1: int, n2: int, u: float) -> float:
    """Two-sided exact probability of a U at least as large, for samples without ties."""
    few, many = sorted((n1, n2))
    # Coefficients of the Gaussian binomial: the number of orderings for every U.
    ways = np.zeros(few * many + 1, dtype=object)
    ways[0] = 1
    for i in range(1, few + 1):
        step = many + i
        ways[step:] = ways[step:] - ways[: max(len(ways) - step, 0)] if step < len(ways) else ways[step:]
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])
    tail = sum(ways[math.ceil(u) :].tolist())
    return min(1.0, 2 * tail / math.comb(n1 + n2, few))


@F.pandas_udf(T.DoubleType())
def exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series(
        [exact_tail(int(a), int(b), float(c)) if pd.notna(a) else None for a, b, c in zip(n1, n2, u)], dtype="float64"
    )


def two_sample_summary(df: DataFrame, groups: Sequence[str], value: str, second: Column) -> DataFrame:
    """Means of both samples and (mean2 - mean1) over the population deviation of the union."""
    groups = list(groups)
    first_mean = F.avg(F.when(~second, F.col(value)))
    second_mean = F.avg(F.when(second, F.col(value)))
    return df.groupBy(*groups).agg(
        first_mean.alias("mean1"),
        second_mean.alias("mean2"),
        F.try_divide(second_mean - first_mean, F.stddev_pop(value)).alias("effect_size"),
    )


def medians(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Exact median per group out of counts per value."""
    groups = list(groups)
    counts = settle(df.groupBy(*groups, value).agg(F.count(value).alias("_n")).where(F.col("_n") > 0))
    cuts = value_cuts(counts, value)
    placed = running_total(counts, groups, [F.col(value)], F.col("_n"), value_bucket(F.col(value), cuts), "_before")
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    lower, upper = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    first, last = F.col("_before") + 1, F.col("_before") + F.col("_n")
    hit = placed.join(sizes, groups).where((first <= upper) & (last >= lower))
    return hit.groupBy(*groups).agg(F.avg(F.col(value).cast("double")).alias("median"))


def summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, population deviation, minimum and maximum."""
    groups = list(groups)
    simple = df.groupBy(*groups).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    return simple.join(medians(df, groups, value), groups, "left")


def chi_square_2x2(df: DataFrame, groups: Sequence[str], success: Column, second: Column) -> DataFrame:
    """Chi-square of a 2×2 table with Yates' correction, per group."""
    counts = df.groupBy(*groups).agg(
        F.count_if(~second & success).cast("double").alias("a"),
        F.count_if(~second & ~success).cast("double").alias("b"),
        F.count_if(second & success).cast("double").alias("c"),
        F.count_if(second & ~success).cast("double").alias("d"),
    )
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    # All four cells are off their expectation by the same amount; the correction never overshoots it.
    off = F.abs(a * d - b * c) / n
    corrected = off - F.least(F.lit(0.5), off)
    statistic = F.try_divide(corrected * corrected * n * n * n, (a + b) * (c + d) * (a + c) * (b + d))
    return counts.select(
        *groups,
        F.try_divide(a, a + b).alias("rate1"),
        F.try_divide(c, c + d).alias("rate2"),
        statistic.alias("chi2"),
        chi_square_p(statistic).alias("p_value"),
        (F.try_divide(c, c + d) - F.try_divide(a, a + b)).alias("effect_size"),
    )
