"""Rounding learned in rounds against a loop over one matrix."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import gram as G
from tiltmeter.operators import rounding as R
from tiltmeter.plans import fixtures as X

RNG = np.random.default_rng(29)
W3 = IntFormat(3)


def rows_of(spark, m, name="w"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"row_id long, {name} array<double>")


def plain_rounds(w, h, shares, rate, steps):
    """Whole matrix at once."""
    places = R.Places(w, W3, 4)
    free = places.start()
    for share in shares:
        far = np.abs(1 / (1 + np.exp(-np.clip(free, -700, 700))) - 0.5)
        limit = np.sort(far.ravel())[max(int(np.ceil(far.size * share)), 1) - 1] if share else -1
        free = np.where(far > limit, np.sign(free) * np.inf, free)
        mean, square = np.zeros_like(free), np.zeros_like(free)
        for step in range(1, steps + 1):
            soft = 1 / (1 + np.exp(-np.clip(free, -700, 700)))
            code = places.below + soft + places.zero
            value = (np.clip(code, 0, 7) - places.zero) * places.pitch
            slope = np.where((code < 0) | (code > 7) | np.isinf(free), 0, places.pitch * soft * (1 - soft))
            gradient = 2 * ((value - w) @ h) * slope
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
            free = free - np.where(np.isinf(free), 0, rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-12))
    return free


@pytest.mark.parametrize("rows_per_block", [2, 100])
def test_rounds_against_a_loop(spark, rows_per_block):
    w, x = RNG.normal(size=(6, 8)), RNG.normal(size=(40, 8))
    h, shares = x.T @ x, (0.5, 0.2, 0.0)
    got = R.progressive_rounding(rows_of(spark, w), G.gram(rows_of(spark, x, "x")), W3, 4, open_shares=shares, steps=7, rows_per_block=rows_per_block)
    rows = got.orderBy("row_id").collect()
    want = plain_rounds(w, h, shares, 0.05, 7)
    free = np.array([r.free for r in rows])
    assert np.isinf(free).all() and (np.sign(free) == np.sign(want)).all()
    places = R.Places(w, W3, 4)
    codes = np.array([r.snapped for r in rows]) / places.pitch + places.zero
    assert codes == pytest.approx(np.clip(places.below + (want > 0) + places.zero, 0, 7))
    for r in rows:
        delta = np.array(r.snapped) - w[r.row_id]
        assert r.loss == pytest.approx(delta @ h @ delta)


def test_each_matrix_has_its_threshold(spark):
    keyed = lambda df: df.withColumn("m", F.when(F.col("row_id") % 2 == 0, "even"))
    w, x = RNG.normal(size=(6, 4)), RNG.normal(size=(40, 4))
    both = R.progressive_rounding(keyed(rows_of(spark, w)), G.gram(keyed(rows_of(spark, x, "x")), keys=["m"]), W3, 4, ["m"], (0.3, 0.0), steps=4).collect()
    for side in (0, 1):
        want = plain_rounds(w[side::2], x[side::2].T @ x[side::2], (0.3, 0.0), 0.05, 4)
        mine = sorted((r for r in both if r.row_id % 2 == side), key=lambda r: r.row_id)
        assert (np.sign([r.free for r in mine]) == np.sign(want)).all() and {r.m for r in mine} == {"even" if side == 0 else None}


def test_error_falls_below_rounding_to_nearest(spark):
    rows = X.weights(spark, "/root/testdata/sf0.001")
    h = G.gram(rows.select(F.col("w").alias("x")))
    m = np.array([r.h for r in h.orderBy("i").collect()])
    w = np.array([r.w for r in rows.collect()])
    places = R.Places(w, IntFormat(4), 16)
    nearest = (np.clip(np.rint(w / places.pitch) + places.zero, 0, 15) - places.zero) * places.pitch - w
    learned = R.progressive_rounding(rows.select("row_id", "w"), h, IntFormat(4), 16).agg(F.sum("loss")).first()[0]
    assert learned < 0.95 * ((nearest @ m) * nearest).sum()
