"""Rotations and sparse outliers against plain loops on small data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import outliers as O
from tiltmeter.operators import rotate as R
from tiltmeter.operators.factors import inverse_factors

RNG = np.random.default_rng(11)
LOOSE = IntFormat(4, round_zero=False)


def rows_of(spark, m, name="w"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"row_id long, {name} array<double>")


def back(df, name="w"):
    return np.array([r[name] for r in df.orderBy("row_id").collect()])


@pytest.mark.parametrize("width", [1, 2, 8, 64])
def test_fast_transform_is_the_matrix(spark, width):
    m = RNG.normal(size=(3, width))
    h = np.array([[(-1.0) ** bin(i & j).count("1") for j in range(width)] for i in range(width)])
    got = back(rows_of(spark, m).withColumn("w", R.walsh_hadamard(F.col("w"))))
    assert got == pytest.approx(m @ h)


@pytest.mark.parametrize("width", [1, 3, 8, 12, 64])
@pytest.mark.parametrize("steps", [None, 1, 7])
def test_rotations_keep_products_and_turn_back(spark, width, steps):
    w, x = RNG.normal(size=(4, width)), RNG.normal(size=(5, width))
    a, b = R.rotate_pair(rows_of(spark, w), rows_of(spark, x, "x"), width, seed=3, steps=steps)
    assert back(a) @ back(b, "x").T == pytest.approx(w @ x.T)
    again = R.rotate_rows(a, "w", width, 3, back=True) if steps is None else R.reflect_rows(a, "w", width, steps, 3, back=True)
    assert back(again) == pytest.approx(w)
    assert np.abs(back(a) - w).max() > 1e-6 or width == 1


def test_rotation_flattens_one_tall_column(spark):
    w = np.zeros((1, 64))
    w[0, 5] = 8.0
    assert np.abs(back(R.rotate_rows(rows_of(spark, w), "w", 64, 1))) == pytest.approx(np.ones((1, 64)))


def test_rotation_of_odd_rows(spark):
    table = spark.createDataFrame([(0, None), (1, []), (2, [1.0, None])], "row_id long, w array<double>")
    for turned in (R.rotate_rows(table, "w", 2), R.reflect_rows(table, "w", 2, 2)):
        rows = turned.orderBy("row_id").collect()
        assert rows[0]["w"] is None and rows[1]["w"] == [] and len(rows[2]["w"]) == 2


def test_norm_pitches_go_in_before(spark):
    w, x, norm = RNG.normal(size=(2, 4)), RNG.normal(size=(2, 4)), [1.0, 2.0, 0.5, 3.0]
    weights = rows_of(spark, w).withColumn("norm", F.lit(norm).cast("array<double>"))
    a, b = R.rotate_pair(weights, rows_of(spark, x, "x"), 4)
    assert back(a) @ back(b, "x").T == pytest.approx((w * norm) @ x.T)
    assert back(rows_of(spark, w).withColumn("w", R.without_mean(F.col("w")))) == pytest.approx(w - w.mean(axis=1, keepdims=True))


def grid(fmt, low, high):
    pitch = max(high - low, 1e-5) / (fmt.high - fmt.low)
    zero = -low / pitch if not fmt.round_zero else float(np.clip(-np.rint(low / pitch), fmt.low, fmt.high))
    return pitch, zero


def snap(fmt, v, pitch, zero):
    inner = np.rint(v / max(pitch, 1e-9) + zero) if not fmt.round_zero else np.rint(v / pitch) + zero
    return (np.clip(inner, fmt.low, fmt.high) - zero) * pitch


def plain_gains(v, d):
    def error(part, unit):
        pitch, zero = grid(LOOSE, min(part), max(part))
        return sum(((snap(LOOSE, x, pitch, zero) - x) / u) ** 2 for x, u in zip(part, unit))

    return [error(v, d) - error([*v[:k], *v[k + 1 :]], [*d[:k], *d[k + 1 :]]) for k in range(len(v))]


def plain_outliers(w, upper, relative, group, fed_back, param_rows=16):
    """(rows, outlier positions, losses) by one loop over columns."""
    fmt, d = IntFormat(4), np.diag(upper)
    threshold = relative * np.mean(w.var(axis=0, ddof=1) / d**2)
    live, kept = w.copy(), np.zeros_like(w)
    out, loss = [[] for _ in w], np.zeros(len(w))
    for c in range(w.shape[1]):
        if c % group == 0:
            pitches, zeros = np.zeros(len(w)), np.zeros(len(w))
            for r in range(len(w)):
                v = list(live[r, c : c + group])
                bad = [g > threshold for g in plain_gains(v, list(d[c : c + group]))]
                good = [x for x, b in zip(v, bad) if not b]
                v = [sum(good) / max(len(good), 1) if b else x for x, b in zip(v, bad)]
                pitches[r], zeros[r] = grid(fmt, min(v), max(v))
            for name in (pitches, zeros):
                for a in range(0, len(w), param_rows):
                    part = name[a : a + param_rows]
                    name[a : a + param_rows] = snap(O.PARAM_FORMAT, part, *grid(O.PARAM_FORMAT, part.min(), part.max()))
        for r in range(len(w)):
            q = snap(fmt, live[r, c], pitches[r], zeros[r])
            error = (live[r, c] - q) / d[c]
            if error**2 > threshold:
                out[r].append(c)
                kept[r, c], error = live[r, c], 0.0
            else:
                kept[r, c] = q
            loss[r] += error**2
            if fed_back:
                live[r, c + 1 :] -= error * upper[c, c + 1 :]
    return kept, out, loss


@pytest.mark.parametrize("fed_back", [False, True])
def test_outliers_against_a_loop(spark, fed_back):
    w, x = RNG.normal(size=(36, 16)), RNG.normal(size=(60, 16))
    w[RNG.random(w.shape) < 0.05] *= 9
    h = x.T @ x
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(h)], "i int, h array<double>")
    factor = inverse_factors(table, tile=5)
    upper = np.array([r.h for r in factor.orderBy("i").collect()])
    fmt, relative = IntFormat(4), 0.02
    if fed_back:
        got = O.outlier_feedback(rows_of(spark, w), factor, fmt, 8, relative, rows_per_block=16)
    else:
        got = O.outlier_groups(rows_of(spark, w), O.column_units(factor), fmt, 8, relative)
    kept, out, loss = plain_outliers(w, upper, relative, 8, fed_back)
    rows = got.orderBy("row_id").collect()
    assert [list(r.outliers) for r in rows] == out and sum(map(len, out)) > 5
    assert [r.loss for r in rows] == pytest.approx(list(loss))
    assert np.array([r.w for r in rows]) == pytest.approx(kept)


def test_outliers_of_several_matrices(spark):
    parts, want = [], {}
    for key in ("a", None):
        w, x = RNG.normal(size=(18, 8)), RNG.normal(size=(60, 8))
        factor = inverse_factors(spark.createDataFrame([(key, i, [float(v) for v in r]) for i, r in enumerate(x.T @ x)], "m string, i int, h array<double>"), keys=["m"])
        parts.append((rows_of(spark, w).withColumn("m", F.lit(key).cast("string")), factor))
        upper = np.array([r.h for r in factor.orderBy("i").collect()])
        want[key] = {fed: plain_outliers(w, upper, 0.05, 4, fed)[2] for fed in (False, True)}
    weights, factor = (parts[0][i].unionByName(parts[1][i]) for i in (0, 1))
    units = O.column_units(factor, ["m"])
    for fed, got in (
        (False, O.outlier_groups(weights, units, IntFormat(4), 4, 0.05, keys=["m"])),
        (True, O.outlier_feedback(weights, factor, IntFormat(4), 4, 0.05, keys=["m"])),
    ):
        rows = got.collect()
        for key in want:
            mine = sorted((r.row_id, r.loss) for r in rows if r.m == key)
            assert [x for _, x in mine] == pytest.approx(list(want[key][fed]))


def test_no_rows(spark):
    empty = rows_of(spark, []).withColumn("m", F.lit("a"))
    units = spark.createDataFrame([], "m string, d array<double>")
    assert O.outlier_groups(empty, units, IntFormat(4), 4, 0.1, keys=["m"]).count() == 0
    with pytest.raises(ValueError):
        O.outlier_feedback(empty, units, IntFormat(4), 4, 0.1, rows_per_block=10)
