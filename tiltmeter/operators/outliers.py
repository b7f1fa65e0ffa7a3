"""Dense grids with a sparse list of outliers: weights that spoil the grid of their group are kept as they are.

The gain of a weight is what the error of its group falls by when it is left out. Weights that gain more than a threshold
give way to the mean of the others when the range of the group is taken; after rounding, weights whose own error exceeds
the threshold are outliers. Pitches and zero points of the groups are on a grid themselves, that of some consecutive
rows. Errors are measured in units of the diagonal of the factored inverse, column by column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.functions.vectors import bound
from tiltmeter.operators.factors import by_keys
from tiltmeter.operators.gram import with_matrix
from tiltmeter.operators.quantize import split_groups
from tiltmeter.operators.ranges import grid_params, grid_snap

#: Rows whose group parameters share a grid.
PARAM_ROWS = 16
PARAM_FORMAT = IntFormat(3, round_zero=False)


def column_units(factor: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, d: per matrix the diagonal of its factor, by column. As wide as a row."""
    cells = factor.select(*keys, F.struct("column", F.element_at("h", F.col("i") + 1).alias("d")).alias("_c"))
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    return packed.select(*keys, F.transform("_c", lambda c: c["d"]).alias("d"))


def thresholds(weights: DataFrame, units: DataFrame, relative: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys…, d, threshold: ``relative`` times the mean over columns of the variance in squared units."""
    columns = weights.select(*keys, F.posexplode("w").alias("pos", "x")).groupBy(*keys, "pos").agg(F.var_samp("x").alias("v"))
    joined = by_keys(columns, units, keys)
    spread = joined.groupBy(*keys).agg((relative * F.avg(F.col("v") / F.pow(F.element_at("d", F.col("pos") + 1), F.lit(2.0)))).alias("threshold"))
    return by_keys(units, spread, keys)


def _error(cells: Column, fmt: IntFormat) -> Column:
    """Squared error of a group in units, rounded to its own grid."""
    low = F.array_min(F.transform(cells, lambda c: c["v"]))
    high = F.array_max(F.transform(cells, lambda c: c["v"]))

    def on_grid(r: Column) -> Column:
        gap = lambda c: (fmt.snap(c["v"], r["pitch"], r["zero"]) - c["v"]) / c["d"]
        return F.aggregate(F.transform(cells, gap), F.lit(0.0), lambda s, e: s + e * e)

    pitched = F.struct(low.alias("low"), fmt.pitch(low, high).alias("pitch"))
    return bound(pitched, lambda r: bound(F.struct(r["pitch"].alias("pitch"), fmt.zero(r["low"], r["pitch"]).alias("zero")), on_grid))


def gains(cells: Column, fmt: IntFormat) -> Column:
    """Per weight of a group (struct v, d) what its error falls by without it."""
    others = lambda i: F.filter(cells, lambda _, j: j != i)
    return bound(_error(cells, fmt), lambda whole: F.transform(cells, lambda _, i: whole - _error(others(i), fmt)))


def without_candidates(cells: Column, threshold: Column, fmt: IntFormat) -> Column:
    """The weights of a group, those that gain more than the threshold as the mean of the others."""
    marked = bound(gains(cells, fmt), lambda g: F.zip_with(cells, g, lambda c, e: F.struct(c["v"].alias("v"), (e > threshold).alias("out"))))

    def fill(some: Column) -> Column:
        kept = F.transform(F.filter(some, lambda s: ~s["out"]), lambda s: s["v"])
        mean = F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(kept), F.lit(1))
        return bound(mean, lambda m: F.transform(some, lambda s: F.when(s["out"], m).otherwise(s["v"])))

    return bound(marked, fill)


def outlier_groups(
    weights: DataFrame,
    units: DataFrame,
    fmt: IntFormat,
    group: int,
    relative: float,
    keys: Sequence[str] = (),
    loose: IntFormat | None = None,
    params: IntFormat = PARAM_FORMAT,
    param_rows: int = PARAM_ROWS,
) -> DataFrame:
    """keys…, row_id, w, outliers (positions), loss: rows on dense grids with their outliers exact. No column sees another.

    ``units`` has keys…, d. ``loose`` is the grid on which gains are measured. The only shuffle brings the rows that
    share parameters together, group by group.
    """
    keys = list(keys)
    loose = loose or IntFormat(fmt.bits, fmt.symmetric, round_zero=False)
    rows = by_keys(weights.select(*keys, "row_id", "w"), thresholds(weights, units, relative, keys), keys)
    cells = F.zip_with("w", "d", lambda v, d: F.struct(v.alias("v"), d.alias("d")))
    split = F.transform(F.sequence(F.lit(0), (F.size("w") / group).cast("int") - 1), lambda i: F.slice(cells, i * group + 1, F.lit(group)))
    checked = F.when(F.size(split_groups(F.col("w"), group)) > 0, split)
    parts = rows.select(*keys, "row_id", "threshold", F.posexplode(checked).alias("group", "cells"))
    filled = parts.withColumn("_fill", without_candidates(F.col("cells"), F.col("threshold"), loose))
    low = F.array_min("_fill")
    ranged = filled.withColumn("pitch", fmt.pitch(low, F.array_max("_fill"))).withColumn("zero", fmt.zero(low, F.col("pitch"))).drop("_fill")
    together = Window.partitionBy(*keys, F.floor(F.col("row_id") / param_rows), "group")
    for name in ("pitch", "zero"):
        ranged = ranged.withColumn(f"_{name}_low", F.min(name).over(together)).withColumn(f"_{name}_high", F.max(name).over(together))
    for name in ("pitch", "zero"):
        step = params.pitch(F.col(f"_{name}_low"), F.col(f"_{name}_high"))
        ranged = ranged.withColumn(f"_{name}_step", step)
        snapped = params.snap(F.col(name), F.col(f"_{name}_step"), params.zero(F.col(f"_{name}_low"), F.col(f"_{name}_step")))
        ranged = ranged.withColumn(name, snapped).drop(f"_{name}_low", f"_{name}_high", f"_{name}_step")

    def judge(c: Column, i: Column) -> Column:
        def one(q: Column) -> Column:
            error = F.pow((c["v"] - q) / c["d"], F.lit(2.0))
            out = error > F.col("threshold")
            return F.struct(
                F.when(out, c["v"]).otherwise(q).alias("q"), F.when(out, F.col("group") * group + i).alias("at"), F.when(out, 0.0).otherwise(error).alias("e")
            )

        return bound(fmt.snap(c["v"], F.col("pitch"), F.col("zero")), one)

    judged = ranged.withColumn("_j", F.transform("cells", judge)).select(*keys, "row_id", F.struct("group", "_j").alias("_g"))
    packed = judged.groupBy(*keys, "row_id").agg(F.array_sort(F.collect_list("_g")).alias("_g"))
    flat = packed.select(*keys, "row_id", F.flatten(F.transform("_g", lambda g: g["_j"])).alias("_j"))
    return flat.select(
        *keys,
        "row_id",
        F.transform("_j", lambda j: j["q"]).alias("w"),
        F.filter(F.transform("_j", lambda j: j["at"]), lambda p: p.isNotNull()).alias("outliers"),
        F.aggregate(F.transform("_j", lambda j: j["e"]), F.lit(0.0), lambda s, e: s + e).alias("loss"),
    )


FED_BACK = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("outliers", T.ArrayType(T.IntegerType())),
        T.StructField("loss", T.DoubleType()),
    ]
)


def _gains(v: np.ndarray, d: np.ndarray, fmt: IntFormat) -> np.ndarray:
    """As :func:`gains`, for rows of groups at once."""

    def error(part: np.ndarray, unit: np.ndarray) -> np.ndarray:
        pitch, zero = grid_params(fmt, part.min(axis=1, keepdims=True), part.max(axis=1, keepdims=True))
        return (((grid_snap(fmt, part, pitch, zero) - part) / unit) ** 2).sum(axis=1)

    whole = error(v, d)
    return np.stack([whole - error(np.delete(v, k, axis=1), np.delete(d, k)) for k in range(v.shape[1])], axis=1)


def _param_grid(values: np.ndarray, params: IntFormat, param_rows: int, rows: np.ndarray) -> np.ndarray:
    """Group parameters on the grid of the rows they share it with."""
    out = np.empty_like(values)
    for block in np.unique(rows // param_rows):
        mine = rows // param_rows == block
        pitch, zero = grid_params(params, values[mine].min(), values[mine].max())
        out[mine] = grid_snap(params, values[mine], pitch, zero)
    return out


def outlier_feedback(
    weights: DataFrame,
    factor: DataFrame,
    fmt: IntFormat,
    group: int,
    relative: float,
    keys: Sequence[str] = (),
    params: IntFormat = PARAM_FORMAT,
    param_rows: int = PARAM_ROWS,
    rows_per_block: int = 4096,
) -> DataFrame:
    """The same with error feedback: each column passes its error on to the columns behind it, outliers pass on none.

    Columns are treated as they come (``factor`` without an order by diagonal), a matrix per key. Blocks of rows hold
    whole sets of rows that share parameters.
    """
    keys = list(keys)
    if rows_per_block % param_rows:
        raise ValueError("blocks have to hold whole sets of rows that share parameters")
    loose = IntFormat(fmt.bits, fmt.symmetric, round_zero=False)
    limits = thresholds(weights, column_units(factor, keys), relative, keys).select(*keys, "threshold")
    stacked = by_keys(factor, limits, keys)
    packed = stacked.select(*keys, "i", F.concat(F.array("threshold", F.col("dead").cast("int").cast("double")), "h").alias("h"))

    def update(pdf: pd.DataFrame, packed_h: np.ndarray) -> pd.DataFrame:
        threshold, dead, upper = packed_h[0, 0], packed_h[:, 1] == 1, packed_h[:, 2:]
        live = np.where(dead, 0.0, np.stack([np.asarray(v, dtype="float64") for v in pdf["w"]]))
        rows, unit = pdf["row_id"].to_numpy(), np.diag(upper)
        kept, out, loss = np.zeros_like(live), np.zeros(live.shape, dtype=bool), np.zeros(len(live))
        for c in range(live.shape[1]):
            if c % group == 0:
                v = live[:, c : c + group]
                out_of = _gains(v, unit[c : c + group], loose) > threshold
                mean = np.where(out_of, 0.0, v).sum(axis=1) / np.maximum((~out_of).sum(axis=1), 1)
                filled = np.where(out_of, mean[:, None], v)
                pitch, zero = grid_params(fmt, filled.min(axis=1), filled.max(axis=1))
                zero = np.broadcast_to(zero, pitch.shape)
                pitch, zero = (_param_grid(p, params, param_rows, rows) for p in (pitch, zero))
            snapped = grid_snap(fmt, live[:, c], pitch, zero)
            error = (live[:, c] - snapped) / unit[c]
            out[:, c] = error**2 > threshold
            kept[:, c] = np.where(out[:, c], live[:, c], snapped)
            error = np.where(out[:, c], 0.0, error)
            loss += error**2
            live[:, c + 1 :] -= error[:, None] * upper[c, c + 1 :]
        places = [np.flatnonzero(o).astype("int32") for o in out]
        return pd.DataFrame({"row_id": rows.astype("int64"), "w": list(kept), "outliers": places, "loss": loss})

    return with_matrix(weights.select(*keys, "row_id", "w"), packed, update, FED_BACK, "row_id", rows_per_block, keys)
