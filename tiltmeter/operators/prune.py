"""Pruning masks, layer importance and the analysis of rows and layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions import vectors as V
from tiltmeter.operators.ordered import attach, kth_smallest
from tiltmeter.operators.quantize import column_profile, packed_profile

FEW_LAYERS = 100_000


def magnitude_threshold(weights: DataFrame, sparsity: float, values: str = "w") -> DataFrame:
    """One row: the magnitude at position floor(n · sparsity) of all weights in ascending order."""
    magnitudes = weights.select(F.explode(F.transform(values, lambda x: F.abs(x))).alias("m"))
    return kth_smallest(magnitudes, [], "m", F.floor(F.col("n") * sparsity) + 1)


def magnitude_prune(weights: DataFrame, sparsity: float, values: str = "w", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Set every weight up to the threshold to zero; adds ``pruned``, how many that were."""
    cut = magnitude_threshold(weights, sparsity, values).select("threshold")
    marked = attach(weights.select(*keep, F.col(values).alias("v")), cut)
    small = F.transform("v", lambda x: F.abs(x) <= F.col("threshold"))
    return marked.select(
        *keep,
        F.zip_with("v", small, lambda x, s: F.when(s, F.lit(0.0)).otherwise(x)).alias(values),
        F.size(F.filter(small, lambda s: s)).alias("pruned"),
    )


def column_power(activations: DataFrame, values: str, samples: Column) -> DataFrame:
    """Squared norm of every column over the number of samples."""
    counted = activations.agg(samples.alias("_n"))
    sums = column_profile(activations, values, {"_s": F.sum(F.col("x") * F.col("x"))})
    return attach(sums, counted).select("pos", (F.col("_s") / F.col("_n")).alias("power"))


def activation_prune(
    weights: DataFrame, activations: DataFrame, sparsity: float, samples: Column, values: str = "w", a_values: str = "x",
    keep: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Drop the share of each row with the least |w| · √(column power); earlier columns go first in a tie.

    The column powers are one row as wide as a weight row, and every weight row is pruned in place.
    """
    power = packed_profile(column_power(activations, a_values, samples), "power")
    rows = attach(weights.select(*keep, F.col(values).alias("v")), power)
    scored = rows.withColumn(
        "_m", F.zip_with("v", "power", lambda x, p: F.abs(x) * F.sqrt(p))
    ).withColumn(
        "_order", F.array_sort(F.transform("_m", lambda m, i: F.struct(m.alias("m"), i.alias("i"))))
    )
    count = F.floor(F.size("v") * F.lit(sparsity)).cast("int")
    dropped = F.array_sort(F.slice(F.col("_order.i"), F.lit(1), count))
    return scored.withColumn("dropped", dropped).select(
        *keep,
        F.transform("v", lambda x, i: F.when(F.array_contains("dropped", i), F.lit(0.0)).otherwise(x)).alias(values),
        "dropped",
    )


def layer_importance(inputs: DataFrame, outputs: DataFrame, layer: str, token: str, values: str = "x") -> DataFrame:
    """Σ over tokens of 1 − cos(input, output) per layer; undefined cosines count as 0.5."""
    pairs = inputs.select(layer, token, F.col(values).alias("_in")).join(
        outputs.select(layer, token, F.col(values).alias("_out")), [layer, token]
    )
    similarity = V.cosine(F.col("_in"), F.col("_out"))
    return pairs.select(layer, F.nanvl(similarity, F.lit(0.5)).alias("_s")).groupBy(layer).agg(
        F.sum(1 - F.col("_s")).alias("importance")
    )


def least_important(importance: DataFrame, n: int, layer: str) -> DataFrame:
    return importance.orderBy("importance", layer).limit(n)


def without_layers(table: DataFrame, importance: DataFrame, n: int, layer: str) -> DataFrame:
    """Rows of the layers that stay. The n layers that go are sent to every task where they are few."""
    gone = least_important(importance, n, layer).select(layer)
    return table.join(F.broadcast(gone) if n <= FEW_LAYERS else gone, layer, "left_anti")


def unchanged(table: DataFrame) -> DataFrame:
    """The dense baseline prunes nothing."""
    return table


def sink_and_window(length: Column, sinks: int, window: int) -> Column:
    """Positions that stay in the cache: the first ``sinks`` and the last ``window − sinks``."""
    positions = F.sequence(F.lit(0), length - 1)
    return F.filter(positions, lambda p: (p < sinks) | (p >= length - (window - sinks)) | (length < window))


def kurtosis_rows(weights: DataFrame, values: str = "w", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    return weights.select(*keep, V.kurtosis(F.col(values)).alias("kurtosis"))


def paired(left: DataFrame, right: DataFrame, key: str, keep: Sequence[str], values: str = "x") -> DataFrame:
    """keep…, a, b: rows of two runs side by side. Runs that come from the same rows need no join; see the functions below."""
    return left.select(key, *keep, F.col(values).alias("a")).join(right.select(key, F.col(values).alias("b")), key)


def cosine_summary(pairs: DataFrame, group: str, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest and mean cosine of the rows ``a`` and ``b`` per group."""
    cosines = pairs.select(group, V.cosine(F.col(a), F.col(b)).alias("_cos"))
    return cosines.groupBy(group).agg(F.min("_cos").alias("min_cos"), F.avg("_cos").alias("avg_cos"), F.count(F.lit(1)).alias("n"))


def batch_loss(pairs: DataFrame, batch: str, a: str = "a", b: str = "b") -> DataFrame:
    """Mean over batches of the mean squared difference within a batch."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    per_batch = pairs.groupBy(batch).agg((F.sum(squares) / F.sum(F.size(a))).alias("loss"))
    return per_batch.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))
