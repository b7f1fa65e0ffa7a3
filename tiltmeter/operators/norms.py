"""Norm tuning: the pitches and offsets of a norm are moved until a compressed run has the channel moments of the full one.

The loss is the mean squared difference of channel means plus that of channel deviations. Both follow from counts, sums and
sums of squares by channel, so the data are read once, and every step works on a table as wide as a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.operators.factors import by_keys


def channel_moments(rows: DataFrame, values: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, pos, mean, std (of a sample) by channel; mergeable, with map-side combine."""
    cells = rows.select(*keys, F.posexplode(values).alias("pos", "_x"))
    return cells.groupBy(*keys, "pos").agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"))


def paired_moments(full: DataFrame, compressed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, channels: ARRAY of struct(pos, mean, std, own_mean, own_std), the full run and the compressed one's own."""
    own = compressed.select(*keys, "pos", F.col("mean").alias("own_mean"), F.col("std").alias("own_std"))
    cells = by_keys(full, own, [*keys, "pos"])
    cell = F.struct("pos", "mean", "std", "own_mean", "own_std")
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("channels"))


def _gaps(c: Column, pitch: Column, offset: Column) -> tuple[Column, Column]:
    """Differences of mean and deviation once the norm has this pitch and offset."""
    return pitch * c["own_mean"] + offset - c["mean"], F.abs(pitch) * c["own_std"] - c["std"]


def norm_loss(channels: Column, norms: Column) -> Column:
    """Mean over channels of the squared gaps; ``norms`` is an ARRAY of struct(pitch, offset)."""

    def squares(c: Column, n: Column) -> Column:
        mean, std = _gaps(c, n["pitch"], n["offset"])
        return mean * mean + std * std

    return F.aggregate(F.zip_with(channels, norms, squares), F.lit(0.0), lambda s, x: s + x) / F.size(channels)


def norm_steps(channels: Column, rate: float, steps: int) -> Column:
    """ARRAY of struct(pitch, offset) after gradient steps from pitch one and offset zero.

    A channel's part of the loss knows only its own pitch and offset, so the gradient is exact and needs no data.
    """
    size = F.size(channels)

    def step(norms: Column, _: Column) -> Column:
        def one(c: Column, n: Column) -> Column:
            mean, std = _gaps(c, n["pitch"], n["offset"])
            pitch = 2 * (mean * c["own_mean"] + std * F.signum(n["pitch"]) * c["own_std"]) / size
            return F.struct((n["pitch"] - rate * pitch).alias("pitch"), (n["offset"] - rate * 2 * mean / size).alias("offset"))

        return F.zip_with(channels, norms, one)

    start = F.transform(channels, lambda c: F.struct(F.lit(1.0).alias("pitch"), F.lit(0.0).alias("offset")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def block_rate(rate: float, gain: float, block: int, blocks: int) -> float:
    """Later blocks move faster: rate (1 + gain block / blocks)."""
    return rate * (1 + gain * block / blocks)


def tuned_norms(full: DataFrame, compressed: DataFrame, values: str, rate: float, steps: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, before, after, norms: the loss without and with the tuned norms. Both tables hold keys… and ``values``."""
    pairs = paired_moments(channel_moments(full, values, keys), channel_moments(compressed, values, keys), keys)
    tuned = pairs.withColumn("norms", norm_steps(F.col("channels"), rate, steps))
    plain = F.transform("channels", lambda c: F.struct(F.lit(1.0).alias("pitch"), F.lit(0.0).alias("offset")))
    return tuned.select(*keys, norm_loss(F.col("channels"), plain).alias("before"), norm_loss(F.col("channels"), F.col("norms")).alias("after"), "norms")
