"""Fake quantisation of weight and activation rows at every granularity.

A weight matrix is a table of rows (row index, ARRAY<DOUBLE>). Ranges that lie within a row are taken
in place. Ranges that span rows (tensor, head, tile, input column) are one grouped min/max with map-side
combine, and come back as a join on the group's key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import FloatFormat, IntFormat, clamp, sigmoid
from tiltmeter.functions.vectors import absolute_max, bound
from tiltmeter.operators.ordered import attach


def split_groups(values: Column, size: int, pad: bool = False) -> Column:
    """Cut a row into groups of ``size``; a short last group is filled with zeros or refused."""
    count = F.ceil(F.size(values) / F.lit(size)).cast("int")
    filled = F.concat(values, F.array_repeat(F.lit(0.0), (count * size - F.size(values)).cast("int"))) if pad else values
    checked = (
        filled
        if pad
        else F.when(F.size(values) % size == 0, values).otherwise(
            F.raise_error(F.lit(f"row width is not divisible by the group size {size}")).cast("array<double>")
        )
    )
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(checked, i * size + 1, F.lit(size)))


def group_rows(df: DataFrame, values: str, size: int | None, keep: Sequence[str], pad: bool = False) -> DataFrame:
    """One row per group: keep…, group, v, low, high. No shuffle."""
    groups = F.array(F.col(values)) if size is None else split_groups(F.col(values), size, pad)
    rows = df.select(*keep, F.posexplode(groups).alias("group", "v"))
    return rows.withColumn("low", F.array_min("v")).withColumn("high", F.array_max("v"))


def apply_format(rows: DataFrame, fmt: IntFormat) -> DataFrame:
    """low, high, v -> pitch, zero, codes, snapped."""
    pitched = rows.withColumn("pitch", fmt.pitch(F.col("low"), F.col("high")))
    zeroed = pitched.withColumn("zero", fmt.zero(F.col("low"), F.col("pitch")))
    return with_codes(zeroed, fmt)


def with_codes(rows: DataFrame, fmt: IntFormat) -> DataFrame:
    pitch, zero = F.col("pitch"), F.col("zero")
    coded = rows.withColumn("codes", F.transform("v", lambda x: fmt.code(x, pitch, zero)))
    return coded.withColumn("snapped", F.transform("codes", lambda q: fmt.value(q, pitch, zero)))


def quantise(
    df: DataFrame, fmt: IntFormat, values: str = "w", group: int | None = None, keep: Sequence[str] = ("row_id",), pad: bool = False
) -> DataFrame:
    """Round to nearest per row (``group=None``) or per group within the row."""
    return apply_format(group_rows(df, values, group, keep, pad), fmt)


def round_rows(
    df: DataFrame, fmt: IntFormat, values: str = "w", group: int | None = None, out: str = "snapped", codes: bool = False
) -> DataFrame:
    """Round to nearest per row or group within the row, in place: the row gets a column with its snapped values or codes.

    For whole rows, where :func:`quantise` would take them apart into groups that have to be put together again.
    """
    groups = F.array(F.col(values)) if group is None else split_groups(F.col(values), group)

    def one(v: Column) -> Column:
        def on_grid(r: Column) -> Column:
            rule = fmt.code if codes else fmt.snap
            return bound(fmt.zero(r["low"], r["pitch"]), lambda zero: F.transform(v, lambda x: rule(x, r["pitch"], zero)))

        low = F.array_min(v)
        return bound(F.struct(low.alias("low"), fmt.pitch(low, F.array_max(v)).alias("pitch")), on_grid)

    return df.withColumn(out, F.flatten(F.transform(groups, one)))


def spanning_ranges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def quantise_tensor(df: DataFrame, fmt: IntFormat, values: str = "w", keep: Sequence[str] = ("row_id",), tensor: str | None = None) -> DataFrame:
    """One range per tensor. Without a tensor column the whole table is one, and its range one broadcast row."""
    rows = group_rows(df, values, None, [*keep, *([tensor] if tensor else [])]).withColumn(
        "_tensor", F.col(tensor) if tensor else F.lit(0)
    )
    ranges = spanning_ranges(rows, ["_tensor"])
    ranges = ranges if tensor else F.broadcast(ranges)
    return apply_format(rows.drop("low", "high").join(ranges, "_tensor"), fmt).drop("_tensor")


def quantise_heads(df: DataFrame, fmt: IntFormat, rows_per_head: int, values: str = "w", row: str = "row_id") -> DataFrame:
    """One range per block of consecutive rows."""
    rows = group_rows(df, values, None, [row]).withColumn("head", F.floor(F.col(row) / rows_per_head).cast("bigint"))
    ranges = spanning_ranges(rows, ["head"])
    return apply_format(rows.drop("low", "high").join(ranges, "head"), fmt)


def quantise_tiles(df: DataFrame, fmt: IntFormat, tile: int, values: str = "w", row: str = "row_id") -> DataFrame:
    """One range per square tile, of the absolute values; tiles at the edge are filled with zeros."""
    rows = group_rows(df, values, tile, [row], pad=True)
    rows = rows.withColumn("tile_row", F.floor(F.col(row) / tile).cast("bigint")).withColumn("high", absolute_max(F.col("v")))
    rows = rows.withColumn("low", F.array_min(F.transform("v", lambda x: F.abs(x))))
    keys = ["tile_row", "group"]
    return apply_format(rows.drop("low", "high").join(spanning_ranges(rows, keys), keys), fmt)


def column_profile(df: DataFrame, values: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row per column position; ``aggregates`` are over ``x``."""
    return df.select(F.posexplode(values).alias("pos", "x")).groupBy("pos").agg(
        *[c.alias(n) for n, c in aggregates.items()]
    )


def packed_profile(profile: DataFrame, *names: str) -> DataFrame:
    """Column profile as one row of arrays in column order; its length is the row width."""
    packed = profile.agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_p"))
    return packed.select(*[F.col(f"_p.{n}").alias(n) for n in names])


def quantise_input_columns(df: DataFrame, fmt: IntFormat, values: str = "w", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """One range per input column: the transposed per-channel rule. The row width bounds what is broadcast."""
    profile = column_profile(df, values, {"low": F.min("x"), "high": F.max("x")})
    profile = profile.withColumn("s", fmt.pitch(F.col("low"), F.col("high")))
    profile = profile.withColumn("z", fmt.zero(F.col("low"), F.col("s")))
    joined = attach(df.select(*keep, F.col(values).alias("v")), packed_profile(profile, "s", "z"))
    coded = joined.withColumn(
        "codes", F.transform("v", lambda x, i: fmt.code(x, F.get("s", i), F.get("z", i)))
    )
    return coded.withColumn(
        "snapped", F.transform("codes", lambda q, i: fmt.value(q, F.get("s", i), F.get("z", i)))
    )


def keep_columns(snapped: Column, original: Column, exact: Column) -> Column:
    """Put the columns listed in ``exact`` back unquantised."""
    return F.zip_with(
        F.transform(snapped, lambda q, i: F.when(F.array_contains(exact, i), F.lit(None)).otherwise(q)),
        original,
        lambda q, x: F.coalesce(q, x),
    )


def quantise_static(rows: DataFrame, fmt: IntFormat, learned: str | None = None) -> DataFrame:
    """Given pitch and zero columns; ``learned`` names an ARRAY of 0/1 that decides floor or ceiling."""
    if learned is None:
        return with_codes(rows, fmt)
    pitch, zero = F.col("pitch"), F.col("zero")
    coded = rows.withColumn(
        "codes",
        F.zip_with("v", learned, lambda x, r: clamp(F.floor(x / pitch).cast("double") + r + zero, fmt.low, fmt.high)),
    )
    return coded.withColumn("snapped", F.transform("codes", lambda q: fmt.value(q, pitch, zero)))


def learnable_range(rows: DataFrame, fmt: IntFormat, low_factor: Column | None, high_factor: Column | None) -> DataFrame:
    """Shrink ranges by the sigmoid of learned factors."""
    if fmt.symmetric:
        if high_factor is None:
            return rows
        reach = sigmoid(high_factor) * F.greatest(F.abs("high"), F.abs("low"), F.lit(1e-5))
        return rows.withColumn("_reach", reach).withColumn("low", -F.col("_reach")).withColumn("high", F.col("_reach")).drop("_reach")
    if low_factor is None or high_factor is None:
        return rows
    return rows.withColumn("low", sigmoid(low_factor) * F.col("low")).withColumn("high", sigmoid(high_factor) * F.col("high"))


def quantise_float(df: DataFrame, fmt: FloatFormat, values: str = "w", group: int | None = None, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Snap to a pitched floating-point grid per row or group."""
    rows = group_rows(df, values, group, keep)
    reach = F.greatest(F.col("high"), -F.col("low"))
    rows = rows.withColumn("reach", reach).withColumn("bias", fmt.bias(F.col("reach")))
    return rows.withColumn(
        "snapped", F.transform("v", lambda x: fmt.snap(x, F.col("reach"), F.col("bias")))
    )


def quantise_two_step(
    df: DataFrame, coarse: IntFormat, fine: IntFormat, group: int, values: str = "w", keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """First per row to ``coarse``, then the codes per group to ``fine``, and back the same way.

    The zero point of the inner step is not clamped to the grid before use beyond the format's own rule.
    """
    outer = quantise(df, coarse, values, None, keep).select(
        *keep, F.col("pitch").alias("outer_pitch"), F.col("zero").alias("outer_zero"), F.col("codes").alias("_codes")
    )
    inner = apply_format(group_rows(outer, "_codes", group, [*keep, "outer_pitch", "outer_zero"]), fine)
    return inner.withColumn(
        "snapped", F.transform("snapped", lambda q: coarse.value(q, F.col("outer_pitch"), F.col("outer_zero")))
    )


def stored_codes(rows: DataFrame, fmt: IntFormat) -> DataFrame:
    """Codes in the narrowest type that holds them, for writing out."""
    return rows.withColumn("codes", F.col("codes").cast(f"array<{fmt.storage}>"))


def calibrated(rows: DataFrame, calibration: DataFrame, fmt: IntFormat, keys: Sequence[str]) -> DataFrame:
    """Quantise with one range per key taken from calibration rows (low, high) only."""
    ranges = spanning_ranges(calibration, keys)
    params = ranges.withColumn("pitch", fmt.pitch(F.col("low"), F.col("high")))
    params = params.withColumn("zero", fmt.zero(F.col("low"), F.col("pitch"))).drop("low", "high")
    return with_codes(rows.drop("low", "high").join(params, list(keys)), fmt)


def stays_exact(position: Column, length: Column, prompt: int, window: int) -> Column:
    """Whether a cached position is still exact: the prompt is quantised at once, later positions wait until ``window``
    of them have come in and are then quantised together."""
    waiting = F.pmod(F.greatest(length - prompt, F.lit(0)), F.lit(window))
    return position >= length - waiting


def row_error(original: Column, snapped: Column) -> Column:
    """Mean squared error of a row."""
    return F.aggregate(
        F.zip_with(original, snapped, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v
    ) / F.size(original)


def smooth_pitch(activations: DataFrame, weights: DataFrame, alpha: float, a_values: str = "x", w_values: str = "w") -> DataFrame:
    """Per column amax(a)^alpha / amax(w)^(1 - alpha), at least 1e-5."""
    a = column_profile(activations, a_values, {"a_max": F.max(F.abs("x"))})
    w = column_profile(weights, w_values, {"w_max": F.greatest(F.max(F.abs("x")), F.lit(1e-5))})
    pitch = F.pow("a_max", F.lit(alpha)) / F.pow("w_max", F.lit(1 - alpha))
    return a.join(w, "pos").select("pos", "a_max", "w_max", F.greatest(pitch, F.lit(1e-5)).alias("pitch"))


def outlier_columns(activations: DataFrame, threshold: float, values: str = "x") -> DataFrame:
    """Column split by the largest absolute activation: at or above the threshold it stays in floating point."""
    profile = column_profile(activations, values, {"a_max": F.max(F.abs("x"))})
    return profile.withColumn("is_outlier", F.col("a_max") >= threshold)


def top_outlier_columns(activations: DataFrame, n: int, threshold: float, values: str = "x") -> DataFrame:
    """The n columns with the largest activation; none if no activation exceeds the threshold.

    One row per column is left when the n are chosen, so the ordering is as wide as a row.
    """
    profile = column_profile(activations, values, {"a_max": F.max(F.abs("x"))})
    best = profile.orderBy(F.desc("a_max"), F.desc("pos")).limit(n).where(F.lit(n) > 0)
    peak = profile.agg(F.max("a_max").alias("_peak"))
    chosen = best.select("pos", F.lit(True).alias("_chosen"))
    marked = attach(profile.join(chosen, "pos", "left"), peak)
    flag = F.coalesce("_chosen", F.lit(False)) & (F.col("_peak") > threshold)
    return marked.select("pos", "a_max", flag.alias("is_outlier"))


def value_histogram(df: DataFrame, value: Column, low: Column, high: Column, bins: int, keys: Sequence[str]) -> DataFrame:
    """Counts per equal-width bin of [low, high]; the upper end belongs to the last bin."""
    place = F.floor((value - low) / (high - low) * bins)
    return (
        df.where(value.between(low, high))
        .select(*keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
