"""Key caches and tuned norms against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.operators import keycache as C
from tiltmeter.operators import norms as N

RNG = np.random.default_rng(17)


def sequences(spark, many):
    return spark.createDataFrame([(i, [[float(x) for x in t] for t in s]) for i, s in enumerate(many)], "seq long, tokens array<array<double>>")


def rope(v, p, size, base=10000.0):
    out, half = v.copy(), size // 2
    for i in range(half):
        a = p / base ** (2 * i / size)
        out[i] = v[i] * np.cos(a) - v[i + half] * np.sin(a)
        out[i + half] = v[i + half] * np.cos(a) + v[i] * np.sin(a)
    return out


@pytest.mark.parametrize("size", [None, 4])
def test_turns_add_up_and_keep_products(spark, size):
    many = [RNG.normal(size=(5, 6)) for _ in range(3)]
    turn = lambda steps: F.transform("tokens", lambda t, i: C.turned(t, i + steps, size))
    got = sequences(spark, many).select(turn(0).alias("a"), turn(7).alias("b")).collect()
    for row, tokens in zip(got, many):
        for p, (a, b, t) in enumerate(zip(row.a, row.b, tokens)):
            assert a == pytest.approx(rope(t, p, size or 6)) and b == pytest.approx(rope(t, p + 7, size or 6))


def test_moved_window(spark):
    many = [RNG.normal(size=(n, 4)) for n in (8, 3, 0)]
    table = sequences(spark, many).withColumn("tokens", F.transform("tokens", lambda t, i: C.turned(t, i)))
    got = [r.t for r in table.select(C.moved_window(F.col("tokens"), 2, 8, 3).alias("t")).collect()]
    want = [rope(many[0][p], p if p < 2 else p - 3, 4) for p in (0, 1, 5, 6, 7)]
    assert np.array(got[0]) == pytest.approx(np.array(want))
    assert np.array(got[1]) == pytest.approx(np.array([rope(t, p, 4) for p, t in enumerate(many[1])])) and got[2] == []


def test_chunks_kept_whole(spark):
    many = [RNG.normal(size=(n, 3)) for n in (17, 12, 5, 3, 0)]
    rows = sequences(spark, many).withColumn("index", C.chunk_index(F.col("tokens"), 4, 2))
    query = F.array(*[F.lit(x) for x in (0.3, -1.0, 0.7)])
    got = rows.select("index.outliers", "index.rest", C.fetched_chunks(F.col("index"), query, 1).alias("fetched")).collect()
    for row, tokens in zip(got, many):
        chunks = [tokens[c * 4 : c * 4 + 4] for c in range(len(tokens) // 4)]
        marks = [c.mean(axis=0) for c in chunks]
        least = [min((t @ m) / (np.linalg.norm(t) * np.linalg.norm(m)) for t in c) for c, m in zip(chunks, marks)]
        out = sorted(sorted(range(len(chunks)), key=lambda c: (least[c], c))[:2])
        rest = [c for c in range(len(chunks)) if c not in out]
        best = sorted(sorted(rest, key=lambda c: -(marks[c] @ np.array([0.3, -1.0, 0.7])))[:1])
        assert (row.outliers, row.rest, row.fetched) == (out, rest, best)


def test_low_rank_keys(spark):
    given = {"a": RNG.normal(size=(30, 2)) @ RNG.normal(size=(2, 6)), None: RNG.normal(size=(25, 6)), "c": np.zeros((4, 6))}
    table = spark.createDataFrame([(k, i, [float(x) for x in r]) for k, m in given.items() for i, r in enumerate(m)], "m string, row_id long, x array<double>").repartition(4)
    basis = C.key_basis(table, (2, 4, 99), keys=["m"])
    rebuilt = C.low_rank_keys(table, basis.where("rank = 2"), keys=["m"]).collect()
    for row in basis.collect():
        s = np.linalg.svd(given[row.m], compute_uv=False)
        assert row.lost == pytest.approx((s[row["rank"] :] ** 2).sum(), abs=1e-9) and len(row.basis) == row["rank"]
    assert {r["rank"] for r in basis.collect()} == {2, 4, 6}
    for key, m in given.items():
        u, s, v = np.linalg.svd(m, full_matrices=False)
        want = (u[:, :2] * s[:2]) @ v[:2]
        mine = [r.rebuilt for r in sorted((r for r in rebuilt if r.m == key), key=lambda r: r.row_id)]
        assert np.array(mine) == pytest.approx(want, abs=1e-8)


def test_norms_by_numeric_gradient(spark):
    full, own = RNG.normal(size=(50, 4)) * [1, 2, 3, 0.5] + 1, RNG.normal(size=(40, 4))
    as_rows = lambda m: spark.createDataFrame([(None, [float(x) for x in r]) for r in m], "m string, v array<double>")
    fm, fs, qm, qs = full.mean(axis=0), full.std(axis=0, ddof=1), own.mean(axis=0), own.std(axis=0, ddof=1)
    loss = lambda n: ((n[0] * qm + n[1] - fm) ** 2).mean() + ((np.abs(n[0]) * qs - fs) ** 2).mean()
    norms = np.array([np.ones(4), np.zeros(4)])
    for _ in range(5):
        slope = np.zeros_like(norms)
        for at in np.ndindex(norms.shape):
            up, down = norms.copy(), norms.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            slope[at] = (loss(up) - loss(down)) / 2e-6
        norms = norms - 0.4 * slope
    (got,) = N.tuned_norms(as_rows(full), as_rows(own), "v", 0.4, 5, ["m"]).collect()
    assert (got.before, got.after) == (pytest.approx(loss(np.array([np.ones(4), np.zeros(4)]))), pytest.approx(loss(norms), rel=1e-5))
    assert [(n.pitch, n.offset) for n in got.norms] == [pytest.approx(x, abs=1e-5) for x in norms.T.tolist()]
    (far,) = N.tuned_norms(as_rows(full), as_rows(own), "v", 0.9, 200, ["m"]).collect()
    assert far.after < 1e-3 < far.before
    assert N.block_rate(0.1, 1.0, 3, 4) == pytest.approx(0.175)
