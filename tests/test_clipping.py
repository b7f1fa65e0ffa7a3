"""Learned clipping against the formula, numeric slopes and the grid search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import clipping as C
from tiltmeter.operators import gram as G
from tiltmeter.plans import fixtures as X

RNG = np.random.default_rng(19)
W4 = IntFormat(4)


def rows_of(spark, m, name="w"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"row_id long, {name} array<double>")


def relaxed(v, low, high, rounds):
    """The snapped value with every rounding as the identity plus what it rounded off at first (``rounds``)."""
    pitch = (high - low) / 15
    zero = -low / pitch + rounds["zero"] if rounds["moves"] else rounds["held"]
    if rounds["state"] == "inside":
        return (v / pitch + rounds["place"]) * pitch
    return ((15.0 if rounds["state"] == "top" else 0.0) - zero) * pitch


def test_slopes_pass_through_roundings():
    v = RNG.normal(size=(3, 2, 6))
    ranges = C.Ranges(v, W4)
    free = RNG.normal(size=(2, 3, 2))
    values, by_low, by_high = ranges.snapped(free)
    low, high = ranges.ends(free)
    for r, g, k in np.ndindex(v.shape):
        a, b = low[r, g], high[r, g]
        pitch = (b - a) / 15
        free_zero, place = np.rint(-a / pitch), np.rint(v[r, g, k] / pitch)
        zero = np.clip(free_zero, 0, 15)
        state = "top" if place + zero > 15 else "bottom" if place + zero < 0 else "inside"
        rounds = {"zero": zero + a / pitch, "place": place - v[r, g, k] / pitch, "state": state, "moves": free_zero == zero, "held": zero}
        f = lambda x, y: relaxed(v[r, g, k], x, y, rounds)  # noqa: B023, E731
        assert values[r, g, k] == pytest.approx(f(a, b))
        assert by_low[r, g, k] == pytest.approx((f(a + 1e-6, b) - f(a - 1e-6, b)) / 2e-6, abs=1e-5)
        assert by_high[r, g, k] == pytest.approx((f(a, b + 1e-6) - f(a, b - 1e-6)) / 2e-6, abs=1e-5)


def test_rows_do_not_depend_on_blocks_of_equal_length(spark):
    """Each row takes its own steps; blocks only share the matrix."""
    w, x = RNG.normal(size=(9, 8)), RNG.normal(size=(40, 8))
    h = G.gram(rows_of(spark, x, "x"))
    got = {n: C.learned_clipping(rows_of(spark, w), h, W4, 4, steps=15, patience=99, rows_per_block=n).orderBy("row_id").collect() for n in (2, 100)}
    for a, b in zip(got[2], got[100]):
        assert (a.loss, a.first_loss, a.steps) == (pytest.approx(b.loss), pytest.approx(b.first_loss), 15)
        delta = np.array(a.w) - w[a.row_id]
        assert delta @ (x.T @ x) @ delta == pytest.approx(a.loss) and a.loss <= a.first_loss
        assert a.low == pytest.approx(b.low) and a.high == pytest.approx(b.high)


def test_several_matrices_and_no_rows(spark):
    w, x = rows_of(spark, RNG.normal(size=(4, 4))), rows_of(spark, RNG.normal(size=(20, 4)), "x")
    keyed = lambda df: df.withColumn("m", F.when(F.col("row_id") % 2 == 0, "even"))
    h = G.gram(keyed(x), keys=["m"])
    got = C.learned_clipping(keyed(w), h, W4, 2, ["m"], steps=5).collect()
    assert sorted((r.row_id, r.m) for r in got) == [(0, "even"), (1, None), (2, "even"), (3, None)]
    assert C.learned_clipping(keyed(w).where("false"), h, W4, 2, ["m"]).count() == 0
    with pytest.raises(ValueError):
        C.learned_clipping(w, h, IntFormat(4, symmetric=True), 2)


def test_error_falls_below_the_grid_search(spark):
    """On the given rows: below plain rounding and below the search over clipped ranges by group."""
    sf = "/root/testdata/sf0.01"
    rows = X.weights(spark, sf)
    h = G.gram(rows.select(F.col("w").alias("x")))
    grid = G.clip_search(rows.select("row_id", "w"), h, W4, X.GROUP, 1, symmetric=False)
    ends = grid.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("group", "low", "high"))).alias("e"))
    m = np.array([r.h for r in h.orderBy("i").collect()])
    searched = 0.0
    for r in rows.select("row_id", "w").join(ends, "row_id").collect():
        v = np.array(r.w)
        q = np.concatenate([C.Ranges(np.clip(v[g * 16 : g * 16 + 16], e.low, e.high)[None, None], W4).snapped(np.full((2, 1, 1), 40.0))[0].ravel() for g, e in enumerate(r.e)])
        searched += (q - v) @ m @ (q - v)
    learned = C.learned_clipping(rows.select("row_id", "w"), h, W4, X.GROUP).agg(F.sum("first_loss").alias("first"), F.sum("loss").alias("loss")).first()
    assert learned.loss < 0.97 * searched and learned.loss < learned.first
