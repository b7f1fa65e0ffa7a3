"""Range calibration: searched, averaged, moving, proximal and histogram-based ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators.ordered import attach, id_bucket, number_within, running

SHRINK_STEPS = 80
SHRINK_GRID = 100
ERROR_POWER = 2.4

RANGE = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("err", T.DoubleType())])


# --- helpers on batches of equally long groups ------------------------------------------------

def _by_width(groups: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and stacked values of the groups of each width."""
    widths = groups.map(len).to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, np.stack([np.asarray(groups.iloc[i], dtype="float64") for i in at])


def grid_params(fmt: IntFormat, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pitch and zero point of many ranges at once; the array form of ``IntFormat``."""
    if fmt.symmetric:
        reach = np.maximum(np.maximum(np.abs(high), np.abs(low)), 1e-5)
        return reach / fmt.high, np.zeros_like(reach)
    pitch = np.maximum(high - low, 1e-5) / (fmt.high - fmt.low)
    if not fmt.round_zero:
        return pitch, fmt.low - low / pitch
    return pitch, np.clip(fmt.low - np.rint(low / pitch), fmt.low, fmt.high)


def grid_snap(fmt: IntFormat, v: np.ndarray, pitch: np.ndarray, zero: np.ndarray) -> np.ndarray:
    if fmt.round_zero:
        codes = np.clip(np.rint(v / pitch) + zero, fmt.low, fmt.high)
    else:
        codes = np.clip(np.rint(v / np.maximum(pitch, 1e-9) + zero), fmt.low, fmt.high)
    return (codes - zero) * pitch


def searched_range(values: Column, fmt: IntFormat) -> Column:
    """struct(low, high, err) of the shrunk range with the least Σ|error|^2.4; the widest wins a tie."""

    @F.pandas_udf(RANGE)
    def search(groups: pd.Series) -> pd.DataFrame:
        out = np.empty((len(groups), 3))
        for at, v in _by_width(groups):
            low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
            best = np.hstack([low, high, np.full_like(low, np.inf)])
            for step in range(SHRINK_STEPS):
                share = 1 - step / SHRINK_GRID
                pitch, zero = grid_params(fmt, share * low, share * high)
                err = (np.abs(grid_snap(fmt, v, pitch, zero) - v) ** ERROR_POWER).sum(axis=1)
                better = err < best[:, 2]
                best[better, 0] = share * low[better, 0]
                best[better, 1] = share * high[better, 0]
                best[better, 2] = err[better]
            out[at] = best
        return pd.DataFrame(out, columns=["low", "high", "err"])

    return search(values)


# --- ranges over batches ---------------------------------------------------------------------

def batch_ranges(rows: DataFrame, keys: Sequence[str], batch: str, values: str = "x") -> DataFrame:
    """Smallest and largest value per batch."""
    return rows.groupBy(*keys, batch).agg(
        F.min(F.array_min(values)).alias("low"), F.max(F.array_max(values)).alias("high")
    )


def mean_range(rows: DataFrame, keys: Sequence[str], batch: str, values: str = "x") -> DataFrame:
    """Mean over batches of the batch ranges."""
    return batch_ranges(rows, keys, batch, values).groupBy(*keys).agg(
        F.avg("low").alias("low"), F.avg("high").alias("high")
    )


def moving_parts(ranges: DataFrame, keys: Sequence[str], batch: str, alpha: float) -> DataFrame:
    """What a run of batches adds to a moving range: keys, n, low, high, first_low, first_high.

    Written out, m ← m + alpha (x − m) over n batches is (1 − alpha)^n m plus batch i weighed by
    alpha (1 − alpha)^(n−1−i). So the fold is a weighted sum and needs no ordered pass over the batches.
    """
    keys = list(keys)
    placed = number_within(ranges, keys, [F.col(batch)], id_bucket(ranges, batch), "_i")
    sizes = ranges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    weight = alpha * F.pow(F.lit(1 - alpha), (F.col("n") - 1 - F.col("_i")).cast("double"))
    first = F.col("_i") == 0
    return placed.join(sizes, keys).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(weight * F.col("low")).alias("low"),
        F.sum(weight * F.col("high")).alias("high"),
        F.max(F.when(first, F.col("low"))).alias("first_low"),
        F.max(F.when(first, F.col("high"))).alias("first_high"),
    )


def moved(parts: DataFrame, keys: Sequence[str], alpha: float, before_low: Column, before_high: Column) -> DataFrame:
    """The moving range after the parts, from the one before them; where there is none it starts at the first batch."""
    left = F.pow(F.lit(1 - alpha), F.col("n").cast("double"))
    low = F.col("low") + left * F.coalesce(before_low, F.col("first_low"))
    high = F.col("high") + left * F.coalesce(before_high, F.col("first_high"))
    return parts.select(*keys, low.alias("low"), high.alias("high"))


def moving_range(rows: DataFrame, keys: Sequence[str], batch: str, alpha: float, values: str = "x") -> DataFrame:
    """Exponentially moving range m ← m + alpha (x − m) in batch order."""
    nothing = F.lit(None).cast("double")
    return moved(moving_parts(batch_ranges(rows, keys, batch, values), keys, batch, alpha), keys, alpha, nothing, nothing)


# --- proximal zero point ---------------------------------------------------------------------

PATH = T.StructType(
    [T.StructField("zeros", T.ArrayType(T.DoubleType())), T.StructField("errors", T.ArrayType(T.DoubleType()))]
)


def proximal_zeros(
    rows: DataFrame, fmt: IntFormat, keys: Sequence[str], beta: float = 10.0, power: float = 0.7, iterations: int = 20
) -> DataFrame:
    """Zero points by half-quadratic splitting; rows need v, pitch, zero.

    When to stop depends on the mean error of the whole tensor. Every group therefore records its
    zero point and error sum after each step in one pass; the stop step follows from the summed
    errors; each group then takes its zero point at that step.
    """
    keys = list(keys)

    @F.pandas_udf(PATH)
    def walk(groups: pd.Series, pitch: pd.Series, zero: pd.Series) -> pd.DataFrame:
        zeros, errors = [None] * len(groups), [None] * len(groups)
        for at, v in _by_width(groups):
            inverse = 1 / pitch.to_numpy()[at][:, None]
            z = zero.to_numpy()[at][:, None]
            zs, es = [], []
            for _ in range(iterations):
                q = np.clip(np.rint(v * inverse + z), fmt.low, fmt.high)
                gap = v - (q - z) / inverse
                size = np.abs(gap)
                with np.errstate(divide="ignore"):
                    threshold = 1 / beta if power == 1 else (1 / beta) * size ** (power - 1)
                e = np.sign(gap) * np.maximum(size - threshold, 0)
                z = (q - (v - e) * inverse).mean(axis=1, keepdims=True)
                zs.append(z[:, 0])
                es.append(size.sum(axis=1))
            for j, i in enumerate(at):
                zeros[i] = [float(s[j]) for s in zs]
                errors[i] = [float(s[j]) for s in es]
        return pd.DataFrame({"zeros": zeros, "errors": errors})

    walked = rows.withColumn("_path", walk("v", "pitch", "zero"))
    sums = walked.agg(
        F.array(*[F.sum(F.get("_path.errors", F.lit(i))) for i in range(iterations)]).alias("_e"),
        F.sum(F.size("v")).alias("_count"),
    )
    # The first step whose error does not improve on the best so far ends the walk.
    start = F.struct(F.lit(1e4).alias("best"), F.lit(-1).alias("stop"), F.lit(0).alias("i"))
    stop = F.aggregate(
        F.transform("_e", lambda e: e / F.col("_count")),
        start,
        lambda s, e: F.struct(
            F.least(s["best"], e).alias("best"),
            F.when((s["stop"] < 0) & (e >= s["best"]), s["i"]).otherwise(s["stop"]).alias("stop"),
            (s["i"] + 1).alias("i"),
        ),
        lambda s: F.when(s["stop"] < 0, s["i"] - 1).otherwise(s["stop"]),
    )
    chosen = attach(walked.drop("zero"), sums.select(stop.alias("steps")))
    return chosen.select(*keys, "v", "pitch", F.get("_path.zeros", F.col("steps")).alias("zero"), "steps")


# --- histogram range -------------------------------------------------------------------------

HIST_BINS = 2048
UPSAMPLE = 16
QUANTILE_STEP = 1e-8


def batch_histograms(rows: DataFrame, keys: Sequence[str], batch: str, values: str = "x", bins: int = HIST_BINS) -> DataFrame:
    """Histograms over the range seen so far, added up over batches that share that range.

    A row per (keys, range) comes out: low, high, first batch, counts ARRAY. As the range only grows,
    there are few of them, whatever the number of batches.
    """
    keys = list(keys)
    ranges = batch_ranges(rows, keys, batch, values)
    seen = running(
        ranges,
        keys,
        [F.col(batch)],
        id_bucket(ranges, batch),
        {"seen_low": ("min", F.col("low")), "seen_high": ("max", F.col("high"))},
    ).select(*keys, batch, "seen_low", "seen_high")
    # Whole arrays meet their range; the values are numbered inside them and leave as bins, which are added up at once.
    span = F.col("seen_high") - F.col("seen_low")
    place = lambda x: F.when(span > 0, F.least(F.floor((x - F.col("seen_low")) / span * bins), F.lit(bins - 1)))
    numbered = F.transform(values, lambda x: F.coalesce(place(x), F.lit(0)).cast("int"))
    points = rows.select(*keys, batch, values).join(seen, [*keys, batch]).select(*keys, batch, "seen_low", "seen_high", F.explode(numbered).alias("bin"))
    counted = points.groupBy(*keys, "seen_low", "seen_high", "bin").agg(F.count(F.lit(1)).alias("n"), F.min(batch).alias("first"))
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    packed = counted.groupBy(*keys, "seen_low", "seen_high").agg(F.min("first").alias("first"), by_bin.alias("_by_bin"))
    return packed.select(
        *keys, F.col("seen_low").alias("low"), F.col("seen_high").alias("high"), "first", F.col("_by_bin").alias("counts")
    )


def widen(counts: np.ndarray, low: float, high: float, new_low: float, new_high: float) -> np.ndarray:
    """Move a histogram into a wider range: every bin is cut fine and its pieces go where their middle lies."""
    bins = len(counts)
    if low == high:
        out = np.zeros(bins)
        place = int((low - new_low) / (new_high - new_low) * bins) if new_high > new_low else 0
        out[min(place, bins - 1)] = counts.sum()
        return out
    fine = bins * UPSAMPLE
    middles = low + (np.arange(fine) + 0.5) * (high - low) / fine
    edges = np.linspace(new_low, new_high, bins + 1)
    place = np.clip(np.searchsorted(edges, middles, side="right") - 1, 0, bins - 1)
    return np.bincount(place, weights=np.repeat(counts / UPSAMPLE, UPSAMPLE), minlength=bins)


def clipping_error(counts: np.ndarray, width: float, first: int, last: int, levels: int) -> float:
    """Squared error if only bins first..last are covered by ``levels`` steps, mass spread evenly in a bin."""
    step = width * (last - first + 1) / levels
    if step == 0:
        return 0.0
    begin = (np.arange(len(counts)) - first) * width
    end = begin + width
    at_begin = np.clip(np.floor(begin / step), 0, levels - 1)
    at_end = np.clip(np.floor(end / step), 0, levels - 1)
    density = counts / width

    def cubes(a, b):
        return density * (b**3 - a**3) / 3

    half = step / 2
    total = cubes(begin - (at_begin + 0.5) * step, half)
    total = total + (at_end - at_begin - 1) * cubes(-half, half)
    total = total + cubes(-half, end - (at_end * step + half))
    return float(total.sum())


def range_moves(counts: np.ndarray, step: float) -> list[tuple[int, int]]:
    """First and last bin after each move that narrows the range, the whole range first.

    Both ends stand at a quantile and could move it inwards by one step; the end that would give up more bins does, the
    right one on a tie. From the cumulated counts follows at which of its steps an end gives up each bin, so only steps
    that give up a bin are listed. The left end moves only while its very next step gives up bins; from then on the
    right end moves alone.
    """
    bins = len(counts)
    share = np.cumsum(counts) / counts.sum()
    from_left = np.floor(share[:-1] / step).astype(np.int64) + 1
    # A bin of the right side goes when the quantile falls below the share up to and with it.
    from_right = np.floor((1 - share[1:]) / step).astype(np.int64) + 1
    left_steps, left_bins = np.unique(from_left, return_counts=True)
    right_steps, right_bins = np.unique(from_right, return_counts=True)
    left, right = dict(zip(left_steps.tolist(), left_bins.tolist())), dict(zip(right_steps.tolist(), right_bins.tolist()))
    first, last, a, b = 0, bins - 1, 0, 0
    moves = [(first, last)]
    while left.get(a + 1, 0) and a + b < 1 / step:
        if left[a + 1] > right.get(b + 1, 0):
            a += 1
            first += left[a]
        else:
            b += 1
            last -= right.get(b, 0)
        moves.append((min(first, last), last))
    for s in sorted(s for s in right if s > b):
        if last <= first or (a + s) * step > 1:
            break
        last = max(first, last - right[s])
        moves.append((first, last))
    return [m for m, before in zip(moves, [None, *moves]) if m != before]


def clip_histogram(counts: np.ndarray, low: float, high: float, levels: int, step: float = QUANTILE_STEP) -> tuple[float, float]:
    """The range that narrowing reaches before the error rises for the first time."""
    width = (high - low) / len(counts)
    moves = range_moves(counts, step)
    errors = [np.inf if k == 0 else clipping_error(counts, width, *ends, levels) for k, ends in enumerate(moves)]
    rising = [k for k in range(1, len(errors)) if errors[k] > errors[k - 1]]
    first, last = moves[rising[0] - 1 if rising else len(moves) - 1]
    return low + width * first, low + width * (last + 1)


def histogram_range(
    rows: DataFrame, keys: Sequence[str], batch: str, fmt_levels: int, values: str = "x", bins: int = HIST_BINS
) -> DataFrame:
    """Clipped range per key from the merged histogram of all batches."""
    keys = list(keys)
    parts = batch_histograms(rows, keys, batch, values, bins)
    types = {f.name: f.dataType for f in parts.schema.fields}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField(n, T.DoubleType()) for n in ("low", "high", "seen_low", "seen_high")]
    )

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = low = high = None
        for part in pdf.sort_values("first").itertuples():
            counts = np.zeros(bins)
            for place, n in dict(part.counts).items():
                counts[place] = n
            if merged is not None:
                counts = counts + widen(merged, low, high, part.low, part.high)
            merged, low, high = counts, part.low, part.high
        clipped = clip_histogram(merged, low, high, fmt_levels)
        return pd.DataFrame([[*key, *clipped, low, high]], columns=schema.names)

    return parts.groupBy(*keys).applyInPandas(fold, schema)


def quantile_bins(histogram: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """First bin at which the cumulated count reaches a share of the total, per key. One row per bin comes in."""
    keys = list(keys)
    upto = Window.partitionBy(*keys).orderBy("bin")
    placed = histogram.withColumn("_c", F.sum("n").over(upto)).withColumn(
        "_total", F.sum("n").over(Window.partitionBy(*keys))
    )
    return placed.where(F.col("_c") >= F.col("_total") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))
