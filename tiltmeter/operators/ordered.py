"""Exact numbering, running totals and k-th values without putting a whole group into one task.

Every operator here cuts the order into buckets that are a fixed function of the sort value, adds up
the buckets first (partial aggregation makes that cheap for a hot group), turns the few bucket totals
into offsets, and finishes inside the buckets. A group holding a third of all rows is therefore spread
over its buckets like everything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.functions.hashing import HASH_BITS
from tiltmeter.session import settle

BUCKETS = 256
FEW_BUCKETS = 16
ROWS_PER_BUCKET = 1 << 20


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a table of exactly one row to every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("__row")).scalar()
    return df.withColumn("__row", packed).select(
        *[F.col(c) for c in df.columns], *[F.col("__row").getField(c).alias(c) for c in one_row.columns]
    )


def hash_bucket(value: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a uniform hash in [0, 2**32)."""
    return F.floor(value / F.lit((1 << HASH_BITS) // buckets)).cast("bigint")


def value_cuts(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Cut points from a mergeable quantile sketch (one bounded row to the driver), more of them for more rows.

    The cuts only balance the buckets. They enter later plans as constants, so a recomputed task
    sees the same buckets, and no result depends on how good they are.
    """
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    row = df.agg(
        F.percentile_approx(column, shares, BUCKETS * 16).alias("cuts"), F.count(column).alias("n")
    ).first()
    wanted = buckets or min(BUCKETS, max(FEW_BUCKETS, row["n"] // ROWS_PER_BUCKET))
    step = max(1, BUCKETS // wanted)
    return sorted(set((row["cuts"] or [])[step - 1 :: step]))


def value_bucket(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts <= value, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(float(cuts[middle])), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(cuts)).cast("bigint")


def id_bucket(df: DataFrame, column: str) -> Column:
    """Bucket of an integer order by quantile cuts of the ids that are there, however far apart they lie."""
    return value_bucket(F.col(column), value_cuts(df, column))


def running_total(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], amount: Column, bucket: Column, out: str
) -> DataFrame:
    """Sum of ``amount`` over the rows that come strictly earlier in the same group.

    ``bucket`` must never decrease along ``order``; ``order`` must be unique within a group.
    """
    keys = [*groups, "_bucket"]
    marked = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    by_bucket = marked.groupBy(*keys).agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .drop("_bucket", "_amount", "_offset")
    )


def number_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], bucket: Column, out: str = "number"
) -> DataFrame:
    """0-based position of every row inside its group."""
    return running_total(df, groups, order, F.lit(1).cast("bigint"), bucket, out)


def running(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    measures: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running sum, min or max up to and including each row: ``{out: (kind, column)}``.

    Same scheme as :func:`running_total`: bucket results first, then offsets, then inside the buckets.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    keys = [*groups, "_bucket"]
    marked = df.withColumn("_bucket", bucket)
    for name, (_, column) in measures.items():
        marked = marked.withColumn(f"_{name}", column)
    per_bucket = marked.groupBy(*keys).agg(*[kinds[k](f"_{n}").alias(f"_t_{n}") for n, (k, _) in measures.items()])
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, *[kinds[k](f"_t_{n}").over(earlier).alias(f"_o_{n}") for n, (k, _) in measures.items()]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.join(offsets, keys)
    for name, (kind, _) in measures.items():
        here, before = kinds[kind](f"_{name}").over(inside), F.col(f"_o_{name}")
        joined = {
            "sum": F.coalesce(before, F.lit(0)) + here,
            "min": F.least(before, here),
            "max": F.greatest(before, here),
        }[kind]
        out = out.withColumn(name, joined)
    return out.drop("_bucket", *[f"_{n}" for n in measures], *[f"_o_{n}" for n in measures])


def kth_smallest(df: DataFrame, groups: Sequence[str], column: str, k: Column, out: str = "threshold") -> DataFrame:
    """One row per group with its k-th smallest value (1-based); ``k`` may use the group size ``n``.

    The values are first only counted per bucket, which moves one row per bucket and group. Then the
    values of the one bucket that holds the k-th are counted one by one: a 256th of the data for any
    distribution, and a value repeated in a third of the rows is a single row by then.
    """
    groups = list(groups)
    cuts = value_cuts(df, column)
    marked = df.select(*groups, column).withColumn("_bucket", value_bucket(F.col(column), cuts))
    per_bucket = marked.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(*groups)
    earlier = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    target = (
        per_bucket.withColumn("n", F.sum("_n").over(everything))
        .withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_k", k.cast("bigint"))
        .where((F.col("_skip") < F.col("_k")) & (F.col("_k") <= F.col("_skip") + F.col("_n")))
        .drop("_n")
    )
    if groups:
        inside = marked.join(target, [*groups, "_bucket"])
    else:
        # One row: it goes into the scan's filter, and nothing outside the bucket is moved.
        inside = attach(marked, target.withColumnRenamed("_bucket", "_target")).where("_bucket = _target")
    counted = settle(
        inside.groupBy(*groups, "n", "_skip", "_k", column).agg(F.count(F.lit(1)).alias("_n"))
    )
    inner_cuts = value_cuts(counted, column)
    placed = running_total(
        counted, groups, [F.col(column)], F.col("_n"), value_bucket(F.col(column), inner_cuts), "_before"
    )
    wanted = F.col("_k") - F.col("_skip")
    return placed.where((F.col("_before") < wanted) & (wanted <= F.col("_before") + F.col("_n"))).select(
        *groups, F.col(column).alias(out), "n"
    )
