"""Rotations of weight and activation rows, so that no column stands out before rounding.

A rotation Q leaves the product alone: (x Q)(w Q)ᵀ = x wᵀ. Every row is turned by itself, as array expressions; signs and
directions come from a hash of a seed and the place, so weights and activations are turned alike wherever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions.hashing import HASH_BITS, portable_hash
from tiltmeter.functions.vectors import bound, dot
from tiltmeter.operators.ordered import attach


def walsh_hadamard(values: Column) -> Column:
    """v H with H[i, j] = (-1)^(ones of i & j), by n log n additions; the length has to be a power of two.

    A fold over the stages: in stage k the places that differ in bit k become their sum and their difference.
    """

    def stage(held: Column, k: Column) -> Column:
        step = F.pow(F.lit(2.0), k).cast("int")

        def one(x: Column, i: Column) -> Column:
            upper = F.floor(i / step) % 2 == 1
            other = F.get(held, F.when(upper, i - step).otherwise(i + step))
            return F.when(upper, other - x).otherwise(x + other)

        return F.transform(held, one)

    stages = F.sequence(F.lit(0), F.floor(F.log2(F.size(values) + 0.5)).cast("int") - 1)
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(stages, values, stage))


def _block(values: Column) -> Column:
    """The largest power of two that divides the length."""
    n = F.size(values)
    return n.bitwiseAND(-n)


def in_blocks(values: Column) -> Column:
    """The transform over each block of the largest power of two that divides the length, scaled to keep lengths."""

    def turn(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), size)
        return F.flatten(F.transform(starts, lambda s: F.transform(walsh_hadamard(F.slice(values, s, size)), lambda v: v / F.sqrt(size))))

    return F.when(F.size(values) > 0, bound(_block(values), turn)).otherwise(values)


def _signs(width: int, seed: int) -> Column:
    sign = lambda i: 1.0 - 2.0 * (portable_hash(F.lit(seed), i, F.lit("sign")) % 2)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), sign)


def rotate_rows(df: DataFrame, values: str, width: int, seed: int = 0, back: bool = False) -> DataFrame:
    """``values`` turned: signs by hash, then the fast transform. ``back`` undoes it.

    The signs are worked out once, as a one-row subquery. Widths that are no power of two are turned inside blocks of
    the largest one that divides them; :func:`reflect_rows` mixes any width. NULL and empty arrays stay as they are.
    """
    signed = attach(df, df.sparkSession.range(1).select(_signs(width, seed).alias("_signs")))
    flip = lambda v: F.zip_with(v, "_signs", lambda x, s: x * s)
    turned = flip(in_blocks(F.col(values))) if back else bound(flip(F.col(values)), in_blocks)
    return signed.withColumn(values, F.when(F.size(values) > 0, turned).otherwise(F.col(values))).drop("_signs")


def _directions(width: int, steps: int, seed: int) -> Column:
    """Normal draws by the polar form of two hashes per place."""
    share = lambda k, i, tag: (portable_hash(F.lit(seed), k, i, F.lit(tag)) + 0.5) / float(1 << HASH_BITS)
    draw = lambda k, i: F.sqrt(-2 * F.log(share(k, i, "r"))) * F.cos(2 * F.pi() * share(k, i, "a"))
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: draw(k, i)))


def reflect_rows(df: DataFrame, values: str, width: int, steps: int, seed: int = 0, back: bool = False) -> DataFrame:
    """``values`` after ``steps`` Householder reflections x - 2 (x u) u / (u u) along hashed normal directions.

    As many steps as the row is wide make a rotation drawn evenly from all of them; each step is one pass over the row.
    """
    ways = attach(df, df.sparkSession.range(1).select(_directions(width, steps, seed).alias("_ways")))

    def reflect(held: Column, u: Column) -> Column:
        return bound(2 * dot(held, u) / dot(u, u), lambda share: F.zip_with(held, u, lambda x, v: x - share * v))

    order = F.reverse("_ways") if back else F.col("_ways")
    turned = F.when(F.size(values) > 0, F.aggregate(order, F.col(values), reflect)).otherwise(F.col(values))
    return ways.withColumn(values, turned).drop("_ways")


def without_mean(values: Column) -> Column:
    """The row less its mean, as a norm that follows does it; lets rows be turned before that norm."""
    return bound(F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values), lambda mean: F.transform(values, lambda v: v - mean))


def rotate_pair(
    weights: DataFrame, activations: DataFrame, width: int, seed: int = 0, steps: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Weights (w) and activations (x) turned alike: by the fast transform, or by ``steps`` reflections.

    A norm's own pitches (``norm`` on the weights, if there) go into the weights first, since they do not commute with
    the rotation.
    """
    if "norm" in weights.columns:
        weights = weights.withColumn("w", F.zip_with("w", "norm", lambda a, b: a * b)).drop("norm")
    if steps is None:
        return rotate_rows(weights, "w", width, seed), rotate_rows(activations, "x", width, seed)
    return reflect_rows(weights, "w", width, steps, seed), reflect_rows(activations, "x", width, steps, seed)
