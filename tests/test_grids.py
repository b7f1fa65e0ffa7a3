"""Two-parameter grids against direct evaluation of the layer output."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import gram as G
from tiltmeter.operators import grids as N

RNG = np.random.default_rng(13)
W4 = IntFormat(4)


def rows_of(spark, m, name="w"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"row_id long, {name} array<double>")


def snapped(v):
    pitch = max(v.max() - v.min(), 1e-5) / 15
    zero = np.clip(-np.rint(v.min() / pitch), 0, 15)
    return (np.clip(np.rint(v / pitch) + zero, 0, 15) - zero) * pitch, pitch, zero


def rounded(w, group):
    return np.array([np.concatenate([snapped(r[g : g + group])[0] for g in range(0, len(r), group)]) for r in w])


@pytest.mark.parametrize("shifted", [True, False])
@pytest.mark.parametrize("spread", [0.2, 3.0, 12.0])
def test_shifted_range_by_outputs(spark, shifted, spread):
    """The loss from moments is that of the outputs themselves, with the shift in the bias."""
    w = RNG.normal(size=(5, 8))
    x = RNG.normal(size=(30, 8)) * spread * RNG.uniform(0.05, 1, size=8) + RNG.normal(size=8) * spread
    c = (x.min(axis=0) + x.max(axis=0)) / 2 if shifted else np.zeros(8)
    moved = x - c
    reach = np.abs(moved).max(axis=0)
    top = reach.max()
    count = 0 if top < 1 else max(10, int(top / 0.5))
    best = None
    for step in range(count + 1):
        bound = top - (step * (top - 1) / count if count else 0)
        s = np.maximum(1, reach / bound)
        out = (moved / s) @ rounded(w * s, 4).T + c @ w.T
        loss = ((out - x @ w.T) ** 2).sum()
        if best is None or loss < best[0]:
            best = (loss, step, bound, s)
    (got,) = N.best_shifted_range(rows_of(spark, w), rows_of(spark, x, "x"), W4, 4, 10, shifted=shifted).collect()
    assert (got.loss, got.step, got.bound) == (pytest.approx(best[0]), best[1], pytest.approx(best[2]))
    assert got.s == pytest.approx(best[3]) and got["shift"] == pytest.approx(c)
    chosen = spark.createDataFrame([([float(v) for v in c],)], "shift array<double>")
    bias = [r.bias for r in N.shift_bias(rows_of(spark, w), chosen).orderBy("row_id").collect()]
    assert bias == pytest.approx(c @ w.T)


def test_shifted_range_of_several_matrices(spark):
    tables, alone = [], {}
    for key in ("a", None):
        w, x = rows_of(spark, RNG.normal(size=(3, 4))), rows_of(spark, RNG.normal(size=(20, 4)) * 6, "x")
        (row,) = N.best_shifted_range(w, x, W4, 2, 5).collect()
        alone[key] = row
        tables.append([t.withColumn("m", F.lit(key).cast("string")) for t in (w, x)])
    both = N.best_shifted_range(tables[0][0].union(tables[1][0]), tables[0][1].union(tables[1][1]), W4, 2, 5, keys=["m"]).collect()
    assert len(both) == 2
    for row in both:
        assert (row.step, row.loss) == (alone[row.m].step, pytest.approx(alone[row.m].loss)) and row.s == pytest.approx(alone[row.m].s)


def plain_nested(w, h, group, row_steps):
    """One row."""
    pitches, zeros = [], []
    for g in range(0, len(w), group):
        v, block = w[g : g + group], h[g : g + group, g : g + group]
        held, best = v.copy(), None
        for step in range(20):
            share = 1.02 - (step + 1) / 20 * 0.22
            held = np.clip(held, v.min() * share, v.max() * share)
            q, pitch, zero = snapped(held)
            loss = (q - v) @ block @ (q - v)
            if best is None or loss < best[0]:
                best = (loss, pitch, zero)
        pitches.append(best[1])
        zeros.append(best[2])
    pitches, zeros, best = np.repeat(pitches, group), np.repeat(zeros, group), None
    for step in range(row_steps):
        share = 1.02 - (step + 1) / row_steps * 0.82
        outer = np.abs(np.clip(w, -np.abs(w).max() * share, np.abs(w).max() * share)).max() / 127
        inner = np.maximum(np.rint(pitches / outer), 1)
        room = np.rint(127 / outer)
        q = np.clip(np.rint(w / (inner * outer)) + zeros, np.maximum(zeros - room, 0), np.minimum(zeros + room, 15))
        delta = (q - zeros) * inner * outer - w
        loss = delta @ h @ delta
        if best is None or loss < best[0]:
            best = (loss, outer, inner[::group], zeros[::group], q)
    return best


def test_nested_scales_against_a_loop(spark):
    w, x = RNG.normal(size=(7, 8)), RNG.normal(size=(40, 8))
    w[0] = np.abs(w[0]) * 0.1 + 1  # all of one sign, so that later clamps are those of the first step
    w[1] = -w[0]
    h = G.gram(rows_of(spark, x, "x"))
    got = N.nested_scales(rows_of(spark, w), h, W4, 4, row_steps=15, rows_per_block=3)
    rows = N.nested_values(got, 4).orderBy("row_id").collect()
    for row, given in zip(rows, w):
        loss, outer, inner, zeros, codes = plain_nested(given, x.T @ x, 4, 15)
        assert (row.loss, row.outer) == (pytest.approx(loss), pytest.approx(outer))
        assert (row.inner, row.zeros, row.codes) == (inner.tolist(), zeros.tolist(), codes.tolist())
        assert (np.array(row.w) - given) @ (x.T @ x) @ (np.array(row.w) - given) == pytest.approx(loss)


def test_nested_scales_of_no_rows(spark):
    assert N.nested_scales(rows_of(spark, []), G.gram(rows_of(spark, RNG.normal(size=(4, 4)), "x")), W4, 4).count() == 0
