"""Second moments of activations, and what is computed from them: layer-output errors and column updates.

The output error of a changed weight row is Δ H Δᵀ with the Gram matrix H = Σ x xᵀ, so activations are
read once, whatever the number of grid points. H has the size of a row squared, however many rows there
are. It meets the weight rows in a co-group per block of rows, so neither the driver nor one task ever
holds the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators.factors import by_keys
from tiltmeter.operators.quantize import group_rows, quantise, quantise_input_columns
from tiltmeter.operators.ranges import grid_params, grid_snap
from tiltmeter.session import settle

BLOCK_ROWS = 4096
#: Matrices that a task adds up at once before it hands them on.
HELD_MATRICES = 4


def _with_keys(df: DataFrame, keys: Sequence[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *fields])


def moment_schema(activations: DataFrame, keys: Sequence[str]) -> T.StructType:
    return _with_keys(activations, keys, T.StructField("i", T.IntegerType()), T.StructField("h", T.ArrayType(T.DoubleType())))


def partial_moments(activations: DataFrame, values: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """keys…, i, h: row i of the sums of x xᵀ over the rows of a task (or some of them); the rows of a matrix add up."""
    keys = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def hand_on() -> Iterator[pd.DataFrame]:
            for key, m in sums.items():
                # pandas has NaN for the NULL key of a group.
                fixed = {k: pd.Series([None if pd.isna(v) else v] * len(m), dtype="object") for k, v in zip(keys, key)}
                yield pd.DataFrame({**fixed, "i": np.arange(len(m), dtype="int32"), "h": list(m)})
            sums.clear()

        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                if len(part):
                    x = np.stack([np.asarray(v, dtype="float64") for v in part[values]])
                    sums[key] = x.T @ x + sums.get(key, 0.0)
            if len(sums) > HELD_MATRICES:
                yield from hand_on()
        yield from hand_on()

    return activations.select(*keys, values).mapInPandas(partial, moment_schema(activations, keys))


def gram(activations: DataFrame, values: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """keys…, i, h ARRAY: row i of Σ x xᵀ, one matrix per key (model, block, layer).

    Each task adds up its own rows and sends its sums row by row, so there are no more tasks than cores: what is
    shuffled grows with the cluster, the keys and the row width, not with the data.
    """
    keys = list(keys)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1].copy()
        first["h"] = [np.sum([np.asarray(h) for h in pdf["h"]], axis=0)]
        return first

    tasks = activations.sparkSession.sparkContext.defaultParallelism
    parts = partial_moments(activations.select(*keys, values).coalesce(tasks), values, keys)
    return parts.groupBy(*keys, "i").applyInPandas(lambda pdf: add_up(pdf), moment_schema(activations, keys))


def pitched_hessian(activations: DataFrame, batch: str, values: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """2/N Σ x xᵀ with N batches: where the running mean over batches ends up. One matrix per key."""
    batches = activations.groupBy(*keys).agg(F.count_distinct(batch).alias("_n"))
    counted = by_keys(gram(activations, values, keys), batches, keys)
    return counted.select(*keys, "i", F.transform("h", lambda v: v * 2 / F.col("_n")).alias("h"))


def with_matrix(
    weights: DataFrame,
    matrix: DataFrame,
    fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: T.StructType,
    row: str = "row_id",
    rows_per_block: int = BLOCK_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Apply ``fn(block of weight rows, d × d matrix)`` block by block; every key has a matrix of its own."""
    keys = list(keys)
    blocks = weights.withColumn("_block", F.floor(F.col(row) / rows_per_block).cast("bigint"))
    # One copy per block that there is, however far apart the ids lie.
    there = blocks.select(*[F.col(k).alias(k) for k in keys], F.col("_block").alias("_at")).distinct()
    copies = by_keys(matrix.select(*keys, "i", "h"), there, keys).withColumnRenamed("_at", "_block")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*keys, *schema.names])
        h = np.stack([np.asarray(r, dtype="float64") for r in right.sort_values("i")["h"]])
        out = fn(left, h)
        return out.assign(**{k: left[k].iloc[0] for k in keys})[[*keys, *schema.names]]

    by = [*keys, "_block"]
    return blocks.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(run, _with_keys(weights, keys, *schema.fields))


# --- column-by-column quantisation with error feedback -------------------------------------------

UPDATED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("snapped", T.ArrayType(T.DoubleType())),
        T.StructField("loss", T.DoubleType()),
    ]
)


def error_feedback(
    weights: DataFrame,
    factor: DataFrame,
    fmt: IntFormat,
    group: int,
    block: int = 128,
    rows_per_block: int = BLOCK_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Quantise column by column: a column is its weights less the errors of all columns before it times the factor.

    Group ranges are taken from the weights corrected by the finished column blocks only. ``factor`` is that of
    :func:`tiltmeter.operators.factors.inverse_factors`, one matrix per key.
    """
    packed = factor.select(
        *keys,
        "i",
        F.concat(F.array(F.col("column").cast("double"), F.col("dead").cast("int").cast("double")), "h").alias("h"),
    )

    def update(pdf: pd.DataFrame, packed_h: np.ndarray) -> pd.DataFrame:
        order, dead, upper = packed_h[:, 0].astype(int), packed_h[:, 1] == 1, packed_h[:, 2:]
        given = np.where(dead, 0.0, np.stack([np.asarray(v, dtype="float64") for v in pdf["w"]])[:, order])
        errors, current, snapped = np.zeros_like(given), np.zeros_like(given), np.zeros_like(given)

        def corrected(columns: slice, known: int) -> np.ndarray:
            """Columns less what the errors of the first ``known`` columns send them."""
            return given[:, columns] - errors[:, :known] @ upper[:known, columns]

        for c in range(given.shape[1]):
            if c % group == 0:
                span = corrected(slice(c, c + group), c - c % block)
                pitch, zero = grid_params(fmt, span.min(axis=1), span.max(axis=1))
            current[:, c] = corrected(slice(c, c + 1), c)[:, 0]
            snapped[:, c] = grid_snap(fmt, current[:, c], pitch, zero)
            errors[:, c] = (current[:, c] - snapped[:, c]) / upper[c, c]
        back = np.argsort(order)
        return pd.DataFrame(
            {
                "row_id": pdf["row_id"].astype("int64"),
                "w": list(current[:, back]),
                "snapped": list(snapped[:, back]),
                "loss": (errors**2).sum(axis=1) / 2,
            }
        )

    return with_matrix(weights.select(*keys, "row_id", "w"), packed, update, UPDATED, "row_id", rows_per_block, keys)


# --- grids judged by the layer output --------------------------------------------------------

def activation_pitch(activations: DataFrame, batch: str, values: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """Mean over batches of the mean absolute activation per column."""
    per_batch = (
        activations.select(*keys, batch, F.posexplode(values).alias("pos", "x"))
        .groupBy(*keys, batch, "pos")
        .agg(F.avg(F.abs("x")).alias("m"))
    )
    return per_batch.groupBy(*keys, "pos").agg(F.avg("m").alias("a"))


def weight_pitch(weights: DataFrame, group: int, values: str = "w", keys: Sequence[str] = ()) -> DataFrame:
    """Mean over rows of |w| relative to the largest of its group, per column."""
    rows = group_rows(weights, values, group, list(keys))
    relative = rows.withColumn("top", F.greatest(F.abs("low"), F.abs("high"))).select(
        *keys, "group", F.posexplode(F.transform("v", lambda x: F.abs(x) / F.col("top"))).alias("place", "r")
    )
    return relative.groupBy(*keys, (F.col("group") * group + F.col("place")).alias("pos")).agg(F.avg("r").alias("w"))


def pitch_candidates(a: DataFrame, w: DataFrame | None, ratios: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Per ratio the pitches of all columns, centred so that the largest and smallest multiply to one.

    With ``w`` a^r / w^(1−r), without it a^r. Rows: step, ratio, s ARRAY.
    """
    joined = a.withColumn("w", F.lit(1.0)) if w is None else a.join(w, [*keys, "pos"])
    grid = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(r)).alias("ratio")) for i, r in enumerate(ratios)])
    raw = joined.select(*keys, "pos", "a", "w", F.inline(grid)).withColumn(
        "s", F.greatest(F.pow("a", F.col("ratio")) / F.pow("w", 1 - F.col("ratio")), F.lit(1e-4))
    )
    packed = raw.groupBy(*keys, "step", "ratio").agg(
        F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("_s"),
        F.sqrt(F.max("s") * F.min("s")).alias("_mid"),
    )
    return packed.select(*keys, "step", "ratio", F.transform("_s", lambda p: p["s"] / F.col("_mid")).alias("s"))


LOSSES = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("loss", T.DoubleType())])


def pitch_losses(
    weights: DataFrame, h: DataFrame, candidates: DataFrame, fmt: IntFormat, group: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Per candidate Σ over weight rows of the output error with pitched, quantised and unpitched weights."""
    grid = candidates.select(*keys, (F.col("step") - 1_000_000).cast("int").alias("i"), F.col("s").alias("h"))
    stacked = h.select(*keys, "i", "h").unionByName(grid)

    def judge(pdf: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        w = np.stack([np.asarray(v, dtype="float64") for v in pdf["w"]])
        d = w.shape[1]
        pitches, moments = m[:-d], m[-d:]
        losses = []
        for s in pitches:
            v = (w * s).reshape(len(w), -1, group)
            pitch, zero = grid_params(fmt, v.min(axis=2, keepdims=True), v.max(axis=2, keepdims=True))
            delta = grid_snap(fmt, v, pitch, zero).reshape(w.shape) / s - w
            losses.append(float(np.einsum("ri,ij,rj->", delta, moments, delta, optimize=True)))
        return pd.DataFrame({"step": np.arange(len(losses), dtype="int32"), "loss": losses})

    parts = with_matrix(weights, stacked, judge, LOSSES, keys=keys)
    return parts.groupBy(*keys, "step").agg(F.sum("loss").alias("loss"))


def best_pitch(
    weights: DataFrame,
    activations: DataFrame,
    batch: str,
    fmt: IntFormat,
    group: int,
    steps: int = 20,
    by_weight: bool = True,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per matrix the column pitches with the least output error over a grid of ratios; the first wins a tie."""
    keys = list(keys)
    a = activation_pitch(activations, batch, keys=keys)
    w = weight_pitch(weights, group, keys=keys) if by_weight else None
    candidates = settle(pitch_candidates(a, w, [i / steps for i in range(steps)], keys))
    losses = pitch_losses(weights, gram(activations, keys=keys), candidates, fmt, group, keys)
    joined = candidates.join(losses, [*keys, "step"])
    best = F.min_by(F.struct("step", "ratio", "s", "loss"), F.struct("loss", "step")).alias("best")
    return joined.groupBy(*keys).agg(best).select(*keys, "best.step", "best.ratio", "best.s", "best.loss")


CLIPPED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("group", T.IntegerType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
    ]
)


def clip_search(
    weights: DataFrame, h: DataFrame, fmt: IntFormat, group: int, n_rows: int, grid: int = 20, shrink: float = 0.5, symmetric: bool = True
) -> DataFrame:
    """Per row and group the clipping of the range by i/grid with the least mean output error of the group."""

    def judge(pdf: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        w = np.stack([np.asarray(v, dtype="float64") for v in pdf["w"]])
        v = w.reshape(len(w), -1, group)
        high = np.abs(v).max(axis=2) if symmetric else v.max(axis=2)
        low = v.min(axis=2)
        blocks = np.stack([m[g * group : (g + 1) * group, g * group : (g + 1) * group] for g in range(v.shape[1])])
        best = np.full(high.shape, np.inf)
        step_at, best_low, best_high = np.zeros(high.shape, dtype="int32"), low.copy(), high.copy()
        for step in range(int(shrink * grid)):
            top = high * (1 - step / grid)
            bottom = -top if symmetric else low * (1 - step / grid)
            clipped = np.clip(v, bottom[..., None], top[..., None])
            pitch, zero = grid_params(fmt, clipped.min(axis=2, keepdims=True), clipped.max(axis=2, keepdims=True))
            delta = grid_snap(fmt, clipped, pitch, zero) - v
            loss = np.einsum("rgi,gij,rgj->rg", delta, blocks, delta, optimize=True) / n_rows
            better = loss < best
            best[better], step_at[better] = loss[better], step
            best_low[better], best_high[better] = bottom[better], top[better]
        rows, groups = np.indices(best.shape)
        return pd.DataFrame(
            {
                "row_id": pdf["row_id"].to_numpy()[rows.ravel()],
                "group": groups.ravel().astype("int32"),
                "step": step_at.ravel(),
                "low": best_low.ravel(),
                "high": best_high.ravel(),
                "loss": best.ravel(),
            }
        )

    return with_matrix(weights.select("row_id", "w"), h, judge, CLIPPED)


DELTA = T.StructType([T.StructField("loss", T.DoubleType())])


def output_error(deltas: DataFrame, h: DataFrame, values: str = "delta") -> DataFrame:
    """One row: Σ Δ H Δᵀ over all rows."""

    def add_up(pdf: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        delta = np.stack([np.asarray(v, dtype="float64") for v in pdf[values]])
        return pd.DataFrame({"loss": [float(((delta @ m) * delta).sum())]})

    return with_matrix(deltas.select("row_id", values), h, add_up, DELTA).agg(F.sum("loss").alias("loss"))


def better_direction(weights: DataFrame, activations: DataFrame, fmt: IntFormat) -> DataFrame:
    """Output error when ranges follow output rows (``oc``) or input columns (``ic``), and which to use."""
    h = gram(activations)

    def loss(snapped: DataFrame, name: str) -> DataFrame:
        gaps = snapped.select("row_id", F.zip_with("snapped", "v", lambda q, x: q - x).alias("delta"))
        return output_error(gaps, h).select(F.lit(name).alias("direction"), "loss")

    both = loss(quantise(weights, fmt), "oc").unionByName(loss(quantise_input_columns(weights, fmt), "ic"))
    pivot = both.agg(
        F.max(F.when(F.col("direction") == "oc", F.col("loss"))).alias("oc_loss"),
        F.max(F.when(F.col("direction") == "ic", F.col("loss"))).alias("ic_loss"),
    )
    return pivot.select("oc_loss", "ic_loss", F.when(F.col("ic_loss") < F.col("oc_loss"), "ic").otherwise("oc").alias("direction"))
