"""Two-parameter grids judged by the layer output: shifted and range-limited columns, and scales nested in scales."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.functions.vectors import dot
from tiltmeter.operators.factors import by_keys
from tiltmeter.operators.gram import gram, pitch_losses, with_matrix
from tiltmeter.operators.ranges import grid_params, grid_snap
from tiltmeter.session import settle

# --- columns moved to the middle of their range, then limited to a common range ---------------

#: Values that one step of the range grid spans at most.
RANGE_STEP = 0.5
LEAST_RANGE = 1.0


def shift_profile(activations: DataFrame, values: str = "x", keys: Sequence[str] = (), shifted: bool = True) -> DataFrame:
    """keys…, n, shift, reach, sums: per matrix the rows and, by column, the middle of the range, the largest magnitude
    once that is subtracted, and the sum. Minima, maxima and sums only, so one pass with map-side combine; a row wide.
    """
    cells = activations.select(*keys, F.posexplode(values).alias("_pos", "_x"))
    columns = cells.groupBy(*keys, "_pos").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_x").alias("_sum"), F.count("_x").alias("_n"))
    moved = columns.withColumn("_shift", (F.col("_lo") + F.col("_hi")) / 2 if shifted else F.lit(0.0))
    reach = F.greatest(F.col("_hi") - F.col("_shift"), F.col("_shift") - F.col("_lo"))
    packed = moved.groupBy(*keys).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_pos", "_shift", reach.alias("_reach"), "_sum"))).alias("_c"))
    take = lambda name: F.transform("_c", lambda c: c[name])
    return packed.select(*keys, "n", take("_shift").alias("shift"), take("_reach").alias("reach"), take("_sum").alias("sums"))


def centred_gram(h: DataFrame, profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, i, h: Σ (x - c)(x - c)ᵀ from Σ x xᵀ, Σ x and n, so that no activation is read again.

    With it, Δ H Δᵀ is the output error of weights that meet shifted activations, the bias holding the shift's share.
    """
    at = lambda name, i: F.element_at(name, i + 1)

    def cell(v: Column, j: Column) -> Column:
        i = F.col("i")
        return v - at("shift", i) * at("sums", j) - at("sums", i) * at("shift", j) + F.col("n") * at("shift", i) * at("shift", j)

    return by_keys(h, profile, keys).select(*keys, "i", F.transform("h", cell).alias("h"))


def range_candidates(profile: DataFrame, steps: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, step, bound, s: common ranges from the largest magnitude down to one, and what each divides columns by.

    At least ``steps`` of them, more where the range is wide. A matrix whose range is below one has the first only.
    """
    top = F.array_max("reach")
    count = F.when(top < LEAST_RANGE, 0).otherwise(F.greatest(F.lit(steps), F.floor(top / RANGE_STEP))).cast("int")
    rows = profile.select(*keys, "reach", top.alias("top"), count.alias("count"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("count"))).alias("step"))
    rows = rows.withColumn("bound", F.col("top") - F.when(F.col("count") > 0, F.col("step") * (F.col("top") - LEAST_RANGE) / F.col("count")).otherwise(0.0))
    divided = F.transform("reach", lambda r: F.greatest(F.lit(1.0), r / F.col("bound")))
    return rows.select(*keys, "step", "bound", divided.alias("s"))


def best_shifted_range(
    weights: DataFrame,
    activations: DataFrame,
    fmt: IntFormat,
    group: int,
    steps: int = 100,
    keys: Sequence[str] = (),
    shifted: bool = True,
) -> DataFrame:
    """keys…, step, bound, s, shift, loss: per matrix the range with the least output error; the widest wins a tie.

    Activations become (x - shift) / s, weights w s, rounded; :func:`shift_bias` has what the bias gains.
    """
    keys = list(keys)
    profile = settle(shift_profile(activations, keys=keys, shifted=shifted))
    candidates = settle(range_candidates(profile, steps, keys))
    losses = pitch_losses(weights, centred_gram(gram(activations, keys=keys), profile, keys), candidates, fmt, group, keys)
    names = [*keys, "step"]
    joined = by_keys(candidates, losses, names)
    best = F.min_by(F.struct("step", "bound", "s", "loss"), F.struct("loss", "step")).alias("best")
    chosen = joined.groupBy(*keys).agg(best).select(*keys, "best.*")
    return by_keys(chosen, profile.select(*keys, "shift"), keys).select(*keys, "step", "bound", "s", "shift", "loss")


def shift_bias(weights: DataFrame, chosen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, row_id, bias: the output of the shift alone, which the bias takes over."""
    rows = by_keys(weights.select(*keys, "row_id", "w"), chosen.select(*keys, "shift"), keys)
    return rows.select(*keys, "row_id", dot(F.col("w"), F.col("shift")).alias("bias"))


# --- integer scales of groups inside a scale of the row ---------------------------------------

NESTED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("outer", T.DoubleType()),
        T.StructField("inner", T.ArrayType(T.IntegerType())),
        T.StructField("zeros", T.ArrayType(T.IntegerType())),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("loss", T.DoubleType()),
    ]
)
#: Largest code of the outer grid.
OUTER = IntFormat(8, symmetric=True)


def nested_scales(
    weights: DataFrame,
    h: DataFrame,
    fmt: IntFormat,
    group: int,
    keys: Sequence[str] = (),
    group_steps: int = 20,
    row_steps: int = 80,
    rows_per_block: int = 4096,
) -> DataFrame:
    """keys…, row_id, outer, inner, zeros, codes, loss: codes whose group scales are whole multiples of a row's scale.

    Two grids. First each group tries ranges from slightly more than its own down to four fifths, every range applied
    to what the one before left, and keeps pitch and zero point of the least output error. Then each row tries outer
    scales for these pitches, which become the nearest whole multiples (at least one). The product of an eight-bit row
    and four-bit codes so stays a sum of integers. ``h`` holds the second moments, a matrix per key; first of equal wins.
    """

    def judge(pdf: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        w = np.stack([np.asarray(v, dtype="float64") for v in pdf["w"]])
        v = w.reshape(len(w), -1, group)
        blocks = np.stack([m[g * group : (g + 1) * group, g * group : (g + 1) * group] for g in range(v.shape[1])])
        low, high = v.min(axis=2, keepdims=True), v.max(axis=2, keepdims=True)
        best = np.full(v.shape[:2], np.inf)
        pitches, zeros = np.ones(best.shape), np.zeros(best.shape)
        held = v
        for step in range(group_steps):
            share = 1.02 - (step + 1) / group_steps * 0.22
            held = np.minimum(np.maximum(held, low * share), high * share)
            pitch, zero = grid_params(fmt, held.min(axis=2, keepdims=True), held.max(axis=2, keepdims=True))
            delta = grid_snap(fmt, held, pitch, zero) - v
            loss = np.einsum("rgi,gij,rgj->rg", delta, blocks, delta, optimize=True)
            better = loss < best
            best[better], pitches[better], zeros[better] = loss[better], pitch[..., 0][better], np.broadcast_to(zero, pitch.shape)[..., 0][better]
        reach = np.abs(w).max(axis=1)
        least, outer = np.full(len(w), np.inf), np.ones(len(w))
        inner, codes = np.ones(pitches.shape), np.zeros(v.shape)
        for step in range(row_steps):
            share = 1.02 - (step + 1) / row_steps * 0.82
            scale = np.maximum(np.minimum(reach, reach * share), 1e-5) / OUTER.high
            times = np.maximum(np.rint(pitches / scale[:, None]), 1.0)
            room = np.rint(OUTER.high / scale)[:, None]
            top, bottom = np.minimum(zeros + room, fmt.high)[..., None], np.maximum(zeros - room, fmt.low)[..., None]
            pitch = (times * scale[:, None])[..., None]
            q = np.minimum(np.maximum(np.rint(v / pitch) + zeros[..., None], bottom), top)
            delta = ((q - zeros[..., None]) * pitch - v).reshape(w.shape)
            loss = np.einsum("ri,ij,rj->r", delta, m, delta, optimize=True)
            better = loss < least
            least[better], outer[better], inner[better], codes[better] = loss[better], scale[better], times[better], q[better]
        return pd.DataFrame(
            {
                "row_id": pdf["row_id"].astype("int64"),
                "outer": outer,
                "inner": list(inner.astype("int32")),
                "zeros": list(zeros.astype("int32")),
                "codes": list(codes.reshape(w.shape).astype("int32")),
                "loss": least,
            }
        )

    return with_matrix(weights.select(*keys, "row_id", "w"), h, judge, NESTED, "row_id", rows_per_block, keys)


def nested_values(rows: DataFrame, group: int) -> DataFrame:
    """The rows of :func:`nested_scales` with ``w``, the weights that codes and scales stand for."""
    place = lambda name, i: F.element_at(name, (F.floor(i / group) + 1).cast("int"))
    value = F.transform("codes", lambda q, i: (q - place("zeros", i)) * place("inner", i) * F.col("outer"))
    return rows.withColumn("w", value)
