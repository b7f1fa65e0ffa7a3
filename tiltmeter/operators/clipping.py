"""Learned clipping: the range of every group is shrunk by gradient descent on the layer output error.

The ends of a range are shares of the smallest and largest weight; a share is the logistic of a free number, which starts
from the best of a few tried group by group. The error
Δ H Δᵀ of a row depends on the shares of its own groups only, so all steps of a block of rows are taken where the rows
are, against one matrix, and nothing is exchanged between steps. Roundings pass gradients on as if they were not there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tiltmeter.functions.quantmath import RANGE_FLOOR, IntFormat
from tiltmeter.operators.gram import BLOCK_ROWS, with_matrix

#: Free numbers that are tried as a start, alike for both ends of a group: shares from 0.9997 down to a half.
STARTS = (8.0, 4.0, 3.0, 2.5, 2.2, 1.7, 1.4, 1.1, 0.8, 0.4, 0.0)
#: Decay of the running mean and square of the gradients.
DECAYS = (0.9, 0.999)

LEARNED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("low", T.ArrayType(T.DoubleType())),
        T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("first_loss", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("steps", T.IntegerType()),
    ]
)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Ranges:
    """Rows cut into groups, with what an asymmetric grid between two ends makes of them and how that changes."""

    def __init__(self, v: np.ndarray, fmt: IntFormat) -> None:
        self.v, self.fmt = v, fmt
        self.low, self.high = v.min(axis=2), v.max(axis=2)

    def ends(self, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = _logistic(free)
        return share[0] * self.low, share[1] * self.high

    def snapped(self, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, their slope by the lower end, by the upper end)."""
        fmt = self.fmt
        low, high = (e[..., None] for e in self.ends(free))
        wide = high - low > RANGE_FLOOR
        pitch = np.maximum(high - low, RANGE_FLOOR) / (fmt.high - fmt.low)
        free_zero = fmt.low - np.rint(low / pitch)
        zero = np.clip(free_zero, fmt.low, fmt.high)
        places = self.v / pitch
        free_code = np.rint(places) + zero
        code = np.clip(free_code, fmt.low, fmt.high)
        # Inside, the value follows its rounded place; at an end it follows that end, which moves pitch and zero point
        # (unless that is at an end itself).
        inside, moves = free_code == code, free_zero == zero
        by_pitch = np.where(inside, np.rint(places) - places, code - zero - np.where(moves, low / pitch, 0.0))
        by_low = np.where(~inside & moves, 1.0, 0.0)
        per_range = np.where(wide, 1 / (fmt.high - fmt.low), 0.0)
        return (code - zero) * pitch, by_low - by_pitch * per_range, by_pitch * per_range


def searched_start(ranges: Ranges, h: np.ndarray) -> np.ndarray:
    """Per group the start with the least error of the group alone; the widest wins a tie."""
    size = ranges.v.shape[2]
    blocks = np.stack([h[g * size : (g + 1) * size, g * size : (g + 1) * size] for g in range(ranges.v.shape[1])])
    free = np.full((2, *ranges.low.shape), STARTS[0])
    best = np.full(ranges.low.shape, np.inf)
    for start in STARTS:
        delta = ranges.snapped(np.full(free.shape, start))[0] - ranges.v
        loss = np.einsum("rgi,gij,rgj->rg", delta, blocks, delta, optimize=True)
        better = loss < best
        best[better], free[:, better] = loss[better], start
    return free


def learn_ranges(w: np.ndarray, h: np.ndarray, fmt: IntFormat, group: int, rate: float, steps: int, patience: int):
    """(lower ends, upper ends, values, first loss, loss, steps taken) of rows against one matrix.

    Adaptive steps as long as any row of the block found a better range within ``patience`` of them; each row keeps the
    best it has seen, the start included.
    """
    ranges = Ranges(w.reshape(len(w), -1, group), fmt)
    free = searched_start(ranges, h)
    mean, square = np.zeros_like(free), np.zeros_like(free)
    best, best_free, since = np.full(len(w), np.inf), free.copy(), 0
    first, step = None, 0
    for step in range(steps + 1):
        values, by_low, by_high = ranges.snapped(free)
        delta = values.reshape(w.shape) - w
        pull = delta @ h
        loss = (pull * delta).sum(axis=1)
        first = loss if first is None else first
        better = loss < best
        best[better] = loss[better]
        best_free[:, better] = free[:, better]
        since = 0 if better.any() else since + 1
        if since >= patience or step == steps:
            break
        slope = 2 * pull.reshape(ranges.v.shape)
        share = _logistic(free)
        by_end = np.stack([(slope * by_low).sum(axis=2) * ranges.low, (slope * by_high).sum(axis=2) * ranges.high])
        gradient = by_end * share * (1 - share)
        mean = DECAYS[0] * mean + (1 - DECAYS[0]) * gradient
        square = DECAYS[1] * square + (1 - DECAYS[1]) * gradient**2
        steady = mean / (1 - DECAYS[0] ** (step + 1)), np.sqrt(square / (1 - DECAYS[1] ** (step + 1)))
        free = free - rate * steady[0] / (steady[1] + 1e-12)
    values, _, _ = ranges.snapped(best_free)
    low, high = ranges.ends(best_free)
    return low, high, values.reshape(w.shape), first, best, step


def learned_clipping(
    weights: DataFrame,
    h: DataFrame,
    fmt: IntFormat,
    group: int,
    keys: Sequence[str] = (),
    rate: float = 0.3,
    steps: int = 100,
    patience: int = 20,
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """keys…, row_id, low, high (ends by group), w, first_loss, loss, steps: rows on the grids of learned ranges.

    ``h`` holds the second moments of the activations, a matrix per key. ``loss`` is never above ``first_loss``, that of
    the starting ranges.
    """
    if fmt.symmetric or not fmt.round_zero:
        raise ValueError("ranges are learned for asymmetric grids with a whole zero point")

    def learn(pdf: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        w = np.stack([np.asarray(v, dtype="float64") for v in pdf["w"]])
        low, high, values, first, loss, taken = learn_ranges(w, m, fmt, group, rate, steps, patience)
        return pd.DataFrame(
            {
                "row_id": pdf["row_id"].astype("int64"),
                "low": list(low),
                "high": list(high),
                "w": list(values),
                "first_loss": first,
                "loss": loss,
                "steps": np.full(len(w), taken, dtype="int32"),
            }
        )

    return with_matrix(weights.select(*keys, "row_id", "w"), h, learn, LEARNED, "row_id", rows_per_block, keys)
