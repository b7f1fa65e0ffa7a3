"""Rounding learned in rounds: weights start between two codes and are decided a share at a time.

Every weight has a soft place between the code below and the one above, the logistic of a free number. A round first
decides the weights whose place is furthest from the middle, as many as leave a given share of the matrix open (an exact
k-th value per matrix, found by buckets), then moves the open ones by gradient steps on Δ H Δᵀ. Rows know only the
matrix, so the steps are taken where the rows are; what is exchanged per round is the threshold of each matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators.clipping import DECAYS
from tiltmeter.operators.gram import BLOCK_ROWS, with_matrix
from tiltmeter.operators.ordered import kth_smallest
from tiltmeter.operators.quantize import split_groups
from tiltmeter.session import settle

#: Places this close to a code start a little away from it, so that their free number is finite.
EDGE = 1e-4
#: Share of the weights that stays open after each round.
OPEN_SHARES = (0.8, 0.6, 0.4, 0.2, 0.08, 0.0)

STATE = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("free", T.ArrayType(T.DoubleType())),
        T.StructField("far", T.ArrayType(T.DoubleType())),
        T.StructField("snapped", T.ArrayType(T.DoubleType())),
        T.StructField("loss", T.DoubleType()),
    ]
)


class Places:
    """Rows on the grids of their groups, with every weight at a place between the codes around it."""

    def __init__(self, w: np.ndarray, fmt: IntFormat, group: int) -> None:
        v = w.reshape(len(w), -1, group)
        low, high = v.min(axis=2, keepdims=True), v.max(axis=2, keepdims=True)
        self.w, self.fmt = w, fmt
        pitch = np.maximum(high - low, 1e-5) / (fmt.high - fmt.low)
        zero = np.clip(fmt.low - np.rint(low / pitch), fmt.low, fmt.high)
        self.pitch, self.zero = (np.broadcast_to(x, v.shape).reshape(w.shape) for x in (pitch, zero))
        self.below = np.floor(w / self.pitch)

    def start(self) -> np.ndarray:
        share = np.clip(self.w / self.pitch - self.below, EDGE, 1 - EDGE)
        return np.log(share / (1 - share))

    def values(self, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, their slope by the free number)."""
        with np.errstate(over="ignore"):
            share = 1 / (1 + np.exp(-free))
        code = self.below + share + self.zero
        inside = (code >= self.fmt.low) & (code <= self.fmt.high)
        value = (np.clip(code, self.fmt.low, self.fmt.high) - self.zero) * self.pitch
        return value, np.where(inside, self.pitch * share * (1 - share), 0.0)


def move_open(places: Places, h: np.ndarray, free: np.ndarray, rate: float, steps: int) -> np.ndarray:
    """The free numbers after gradient steps; decided ones are infinite and have no slope."""
    mean, square, free = np.zeros_like(free), np.zeros_like(free), free.copy()
    open_ = np.isfinite(free)
    for step in range(1, steps + 1):
        value, slope = places.values(free)
        gradient = np.where(open_, 2 * ((value - places.w) @ h) * slope, 0.0)
        mean = DECAYS[0] * mean + (1 - DECAYS[0]) * gradient
        square = DECAYS[1] * square + (1 - DECAYS[1]) * gradient**2
        move = rate * (mean / (1 - DECAYS[0] ** step)) / (np.sqrt(square / (1 - DECAYS[1] ** step)) + 1e-12)
        free = np.where(open_, free - move, free)
    return free


def progressive_rounding(
    weights: DataFrame,
    h: DataFrame,
    fmt: IntFormat,
    group: int,
    keys: Sequence[str] = (),
    open_shares: Sequence[float] = OPEN_SHARES,
    rate: float = 0.05,
    steps: int = 40,
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """keys…, row_id, w, snapped, loss (and free, far): every weight on the code below or above it.

    ``h`` holds the second moments of the activations, a matrix per key. Of equal distances at the threshold all stay
    open until the last round, which decides what is left by the side of the middle it is on.
    """
    keys = list(keys)
    if fmt.symmetric or not fmt.round_zero:
        raise ValueError("rounding is learned on asymmetric grids with a whole zero point")
    checked = weights.where(F.size(split_groups(F.col("w"), group)) > 0).select(*keys, "row_id", "w")

    def begin(pdf: pd.DataFrame, m: np.ndarray) -> pd.DataFrame:
        return advance(pdf, m, None)

    def advance(pdf: pd.DataFrame, m: np.ndarray, threshold: float | None) -> pd.DataFrame:
        places = Places(np.stack([np.asarray(v, dtype="float64") for v in pdf["w"]]), fmt, group)
        if threshold is None:
            free = places.start()
        else:
            free = np.stack([np.asarray(v, dtype="float64") for v in pdf["free"]])
            far = np.stack([np.asarray(v, dtype="float64") for v in pdf["far"]])
            free = np.where(far > threshold, np.where(free > 0, np.inf, -np.inf), free)
            free = move_open(places, m, free, rate, steps)
        value = places.values(np.where(free > 0, np.inf, -np.inf))[0]
        delta = value - places.w
        loss = ((delta @ m) * delta).sum(axis=1)
        return pd.DataFrame({"row_id": pdf["row_id"].astype("int64"), "w": pdf["w"], "free": list(free), "far": list(distances(free)), "snapped": list(value), "loss": loss})

    def next_round(pdf: pd.DataFrame, packed: np.ndarray) -> pd.DataFrame:
        return advance(pdf, packed[:, 1:], packed[0, 0])

    # A name for the matrix that is there for NULL keys too.
    name = F.to_json(F.struct(*keys) if keys else F.struct(F.lit(0))).alias("_matrix")
    state = settle(with_matrix(checked, h, begin, STATE, "row_id", rows_per_block, keys))
    for share in open_shares:
        # A share of the matrix stays open: the k smallest distances from the middle. In the last round none does.
        named = h.select(*keys, "i", "h", name)
        if share > 0:
            far = state.select(name, F.explode("far").alias("far"))
            limits = kth_smallest(far, ["_matrix"], "far", F.greatest(F.ceil(F.col("n") * share), F.lit(1)))
            stacked = named.join(limits.select("_matrix", "threshold"), "_matrix")
        else:
            stacked = named.withColumn("threshold", F.lit(-1.0))
        packed = stacked.select(*keys, "i", F.concat(F.array("threshold"), "h").alias("h"))
        state = settle(with_matrix(state, packed, next_round, STATE, "row_id", rows_per_block, keys))
    return state


def distances(free: np.ndarray) -> np.ndarray:
    """How far a place is from the middle between two codes."""
    with np.errstate(over="ignore"):
        return np.abs(1 / (1 + np.exp(-free)) - 0.5)
