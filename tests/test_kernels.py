"""Kernels without an SQL counterpart against plain loops on small data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import factors
from tiltmeter.operators import gram as G
from tiltmeter.operators import quantize as Q
from tiltmeter.operators import ranges as N
from tiltmeter.operators import reduce as R
from tiltmeter.operators.factors import inverse_factors

RNG = np.random.default_rng(7)


def matrix_table(spark, m, name="w"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"row_id long, {name} array<double>")


def snap4(v, pitch, zero):
    return (np.clip(np.rint(v / pitch) + zero, 0, 15) - zero) * pitch


def params4(v):
    pitch = max(v.max() - v.min(), 1e-5) / 15
    return pitch, np.clip(-np.rint(v.min() / pitch), 0, 15)


def test_error_feedback_column_by_column(spark):
    w, x = RNG.normal(size=(6, 8)), RNG.normal(size=(40, 8))
    x[:, 5] = 0
    table = spark.createDataFrame([(i // 10, [float(v) for v in r]) for i, r in enumerate(x)], "batch long, x array<double>")
    factor = inverse_factors(G.pitched_hessian(table, "batch"), by_diagonal=True, tile=3)
    got = {r["row_id"]: r for r in G.error_feedback(matrix_table(spark, w), factor, IntFormat(4), 4, block=3, rows_per_block=4).collect()}

    h = 2 / 4 * x.T @ x
    dead = np.diag(h) == 0
    h[dead, dead] = 1
    order = np.argsort(-np.diag(h), kind="stable")
    h = h[order][:, order] + np.eye(8) * 0.01 * np.diag(h).mean()
    u = np.linalg.cholesky(np.linalg.inv(h)).T
    for row in range(6):
        live = w[row].copy()
        live[dead] = 0
        live = live[order]
        seen = live.copy()
        snapped, loss = np.zeros(8), 0.0
        for c in range(8):
            if c % 3 == 0:
                seen = live.copy()
            if c % 4 == 0:
                pitch, zero = params4(seen[c : c + 4])
            q = snap4(live[c], pitch, zero)
            err = (live[c] - q) / u[c, c]
            loss += err**2 / 2
            snapped[c] = q
            live[c + 1 :] -= err * u[c, c + 1 :]
        back = np.empty(8)
        back[order] = snapped
        assert got[row]["snapped"] == pytest.approx(back, abs=1e-9)
        assert got[row]["loss"] == pytest.approx(loss)


def plain_factor(h, by_diagonal):
    h = h.copy()
    dead = np.diag(h) == 0
    h[dead, dead] = 1
    order = np.argsort(-np.diag(h), kind="stable") if by_diagonal else np.arange(len(h))
    h = h[order][:, order]
    h += np.eye(len(h)) * 0.01 * np.diag(h).mean()
    return order, dead, np.linalg.cholesky(np.linalg.inv(h)).T


@pytest.mark.parametrize("tile", [1, 4, 7, 64])
@pytest.mark.parametrize("by_diagonal", [False, True])
def test_factors_of_many_matrices(spark, tile, by_diagonal):
    """Of different widths, with dead columns and a NULL key, in tile rows of any height."""
    given, rows = {}, []
    for key, width in (("a", 10), ("b", 3), (None, 7), ("c", 1)):
        x = RNG.normal(size=(30, width))
        x[:, width // 2] *= key != "a"
        given[key] = x.T @ x
        rows += [(key, i, [float(v) for v in r]) for i, r in enumerate(given[key])]
    table = spark.createDataFrame(rows, "m string, i int, h array<double>").repartition(3)
    got = inverse_factors(table, by_diagonal=by_diagonal, keys=["m"], tile=tile).collect()
    for key, h in given.items():
        order, dead, upper = plain_factor(h, by_diagonal)
        mine = sorted((r for r in got if r.m == key), key=lambda r: r.i)
        assert [r.i for r in mine] == list(range(len(h))) and [r.column for r in mine] == order.tolist()
        assert [r.dead for r in mine] == dead[order].tolist()
        assert np.array([r.h for r in mine]) == pytest.approx(upper, abs=1e-9)


def test_factor_tile_rows_are_bounded(spark):
    """No record holds more than a tile row of one matrix."""
    h = RNG.normal(size=(60, 40))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(h.T @ h)], "i int, h array<double>")
    orders = factors.column_orders(table, 0.01, False, [])
    tiles = factors.tile_rows(table, orders, [], 8)
    assert [r.n for r in tiles.select(F.size("rows").alias("n")).collect()] == [8] * 5
    sizes = factors.inverse_rows(tiles, [], 8).select(F.octet_length("x").alias("n")).collect()
    assert [r.n for r in sizes] == [8 * 40 * 8] * 5


def test_no_matrices(spark):
    assert inverse_factors(spark.createDataFrame([], "m string, i int, h array<double>"), keys=["m"]).count() == 0


def test_error_feedback_by_matrix(spark):
    """Each matrix of its own, as the same rows alone."""
    tables = []
    for key in ("a", "b"):
        w, x = RNG.normal(size=(5, 8)), RNG.normal(size=(40, 8))
        weights = matrix_table(spark, w).withColumn("m", F.lit(key))
        acts = spark.createDataFrame([(key, i // 10, [float(v) for v in r]) for i, r in enumerate(x)], "m string, batch long, x array<double>")
        tables.append((weights, acts))
    def run(weights, acts):
        factor = inverse_factors(G.pitched_hessian(acts, "batch", keys=["m"]), keys=["m"], tile=4)
        return {(r.m, r.row_id): (r.loss, *r.snapped) for r in G.error_feedback(weights, factor, IntFormat(4), 4, keys=["m"], rows_per_block=3).collect()}

    both = run(tables[0][0].union(tables[1][0]), tables[0][1].union(tables[1][1]))
    alone = run(*tables[0]) | run(*tables[1])
    assert both.keys() == alone.keys() and len(both) == 10
    for key, value in alone.items():
        assert both[key] == pytest.approx(value)


def test_gram_over_many_tasks(spark):
    x = RNG.normal(size=(100, 5))
    rows = G.gram(matrix_table(spark, x, "x").repartition(7)).orderBy("i").collect()
    assert np.array([r["h"] for r in rows]) == pytest.approx(x.T @ x)


def test_proximal_zeros_stop_for_the_whole_tensor(spark):
    w = RNG.normal(size=(12, 16))
    fmt = IntFormat(4)
    rows = Q.quantise(matrix_table(spark, w), fmt, group=8)
    got = {(r["row_id"], r["group"]): r for r in N.proximal_zeros(rows, fmt, ["row_id", "group"]).collect()}
    v = w.reshape(-1, 8)
    pitch = np.maximum(v.max(1) - v.min(1), 1e-5)[:, None] / 15
    zero = np.clip(-np.rint(v.min(1)[:, None] / pitch), 0, 15)
    best, steps = 1e4, 0
    for steps in range(20):
        q = np.clip(np.rint(v / pitch + zero), 0, 15)
        gap = v - (q - zero) * pitch
        e = np.sign(gap) * np.maximum(np.abs(gap) - 0.1 * np.abs(gap) ** -0.3, 0)
        zero = (q - (v - e) / pitch).mean(1, keepdims=True)
        error = np.abs(gap).mean()
        if error >= best:
            break
        best = error
    for (row, group), r in got.items():
        assert r["zero"] == pytest.approx(zero[row * 2 + group, 0])
        assert r["steps"] == steps


@pytest.mark.parametrize("seed", range(6))
def test_histogram_search_ends_where_the_error_stops_falling(seed):
    rng = np.random.default_rng(seed)
    values = rng.standard_t(3, size=4000) if seed % 2 else rng.exponential(size=4000)
    counts, edges = np.histogram(values, bins=64)
    counts, width, step = counts.astype(float), (edges[-1] - edges[0]) / 64, 1e-4
    low, high = N.clip_histogram(counts, edges[0], edges[-1], 16, step)
    first, last = round((low - edges[0]) / width), round((high - edges[0]) / width) - 1
    here = N.clipping_error(counts, width, first, last, 16)
    assert 0 <= first <= last < 64
    moves = N.range_moves(counts, step)
    errors = [np.inf, *(N.clipping_error(counts, width, *ends, 16) for ends in moves[1:])]
    assert (first, last) in moves
    at = moves.index((first, last))
    assert errors[: at + 1] == sorted(errors[: at + 1], reverse=True) and (at + 1 == len(moves) or errors[at + 1] > here)


def test_range_moves_give_up_bins_of_both_sides():
    """Empty bins at the left go at once, because the right end gives up fewer; the full ones go one by one."""
    assert N.range_moves(np.array([0.0, 0.0, 4.0, 4.0, 1.0, 1.0]), 0.05) == [(0, 5), (2, 5), (2, 4), (2, 3), (2, 2)]


def test_clipping_error_is_the_error_of_the_grid():
    """Many evenly spread points in every bin, snapped to the middle of their step."""
    counts, width, first, last, levels = np.array([1.0, 4.0, 2.0, 3.0, 0.0, 5.0]), 0.5, 1, 4, 4
    step, start = width * (last - first + 1) / levels, first * width
    total = 0.0
    for i, n in enumerate(counts):
        x = (i + (np.arange(20000) + 0.5) / 20000) * width
        level = np.clip(np.floor((x - start) / step), 0, levels - 1)
        total += n * ((x - (start + (level + 0.5) * step)) ** 2).mean()
    assert N.clipping_error(counts, width, first, last, levels) == pytest.approx(total, rel=1e-6)


def test_histogram_range_merges_in_batch_order(spark):
    batches = [RNG.normal(0, s, size=200) for s in (1, 1, 3, 2, 5)]
    rows = [(0, b, [float(x) for x in v]) for b, v in enumerate(batches)]
    table = spark.createDataFrame(rows, "input int, batch long, x array<double>")
    got = N.histogram_range(table, ["input"], "batch", 256, bins=32).first()
    merged = low = high = None
    for v in batches:
        new_low, new_high = (v.min(), v.max()) if low is None else (min(low, v.min()), max(high, v.max()))
        counts = np.histogram(v, bins=32, range=(new_low, new_high))[0].astype(float)
        if merged is not None:
            same = (low, high) == (new_low, new_high)
            counts += merged if same else N.widen(merged, low, high, new_low, new_high)
        merged, low, high = counts, new_low, new_high
    assert (got["seen_low"], got["seen_high"]) == pytest.approx((low, high))
    assert (got["low"], got["high"]) == pytest.approx(N.clip_histogram(merged, low, high, 256, 1e-5), abs=(high - low) / 32 + 1e-9)
    assert merged.sum() == pytest.approx(1000)


def test_moving_range_is_the_ordered_fold(spark):
    rows = [("a", b, [float(x) for x in RNG.normal(size=4)]) for b in range(30)] + [("b", 3, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "input string, batch long, x array<double>").repartition(5)
    got = {r["input"]: r for r in N.moving_range(table, ["input"], "batch", 0.1).collect()}
    low = high = None
    for _, _, v in rows[:30]:
        low = min(v) if low is None else low + 0.1 * (min(v) - low)
        high = max(v) if high is None else high + 0.1 * (max(v) - high)
    assert (got["a"]["low"], got["a"]["high"]) == pytest.approx((low, high))
    assert (got["b"]["low"], got["b"]["high"]) == (1.0, 2.0)


def test_snapped_values_stay_within_half_a_step(spark):
    table = matrix_table(spark, RNG.normal(size=(20, 32)))
    for fmt in (IntFormat(4), IntFormat(8), IntFormat(3)):
        for r in Q.quantise(table, fmt, group=16).collect():
            v, s, z = np.array(r["v"]), r["pitch"], r["zero"]
            inside = (v >= (fmt.low - z) * s) & (v <= (fmt.high - z) * s)
            assert (np.abs(np.array(r["snapped"]) - v)[inside] <= s / 2 + 1e-12).all()


def test_group_size_has_to_divide_unless_padded(spark):
    table = matrix_table(spark, RNG.normal(size=(2, 10)))
    with pytest.raises(Exception, match="not divisible"):
        Q.quantise(table, IntFormat(4), group=4).collect()
    padded = Q.quantise(table, IntFormat(4), group=4, pad=True).collect()
    assert len(padded) == 6 and padded[2]["v"][2:] == [0.0, 0.0]
    with pytest.raises(Exception, match="not divisible"):
        Q.quantise(table, IntFormat(4), group=16).collect()


# --- selectors -------------------------------------------------------------------------------

def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def row_of(spark, m):
    return spark.createDataFrame([(m.tolist(),)], "tokens array<array<double>>")


def test_farthest_points_one_by_one(spark):
    m = RNG.normal(size=(20, 4))
    distance = 1 - unit(m) @ unit(m).T
    chosen = []
    for step in range(6):
        if step == 0:
            scores = [sorted(distance[:, j])[1] for j in range(20)]
        else:
            scores = [min(distance[i, j] for i in chosen) for j in range(20)]
        chosen.append(int(np.argmax(scores)))
    assert row_of(spark, m).select(R.farthest_points(F.col("tokens"), 0.3)).first()[0] == chosen


def test_pivots_take_unlike_tokens(spark):
    m = RNG.normal(size=(14, 4))
    kept = row_of(spark, m).select(R.pivots_and_unlike(F.col("tokens"), 10, 2, 2, 0.2)).first()[0]
    size = np.abs(m).sum(1)
    own = sorted(range(10), key=lambda i: (-size[i], i))[:2]
    text = sorted(range(10, 14), key=lambda i: (-size[i], i))[:2]
    left, expected = [i for i in range(10) if i not in own], set(own)
    for p in sorted(own + text):
        near = sorted(left, key=lambda i: (unit(m)[i] @ unit(m)[p], i))[: int(10 * 0.8 / 4)]
        expected |= set(near)
        left = [i for i in left if i not in near]
    assert kept == sorted(expected) and len(kept) == 10 * 8 // 10 + 2


def test_distinct_tokens_drop_copies(spark):
    m = np.vstack([np.eye(6), np.eye(6)]) + RNG.normal(0, 1e-3, size=(12, 6))
    scores = np.linspace(1, 0, 12)
    row = spark.createDataFrame([(m.tolist(), scores.tolist())], "tokens array<array<double>>, scores array<double>")
    kept = row.select(R.important_and_distinct(F.col("tokens"), F.col("scores"), 0.5, 0.34, batch=1)).first()[0]
    assert len(kept) == 6 and kept[:2] == [0, 1]


def test_density_clusters_find_the_blobs(spark):
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    m = np.vstack([c + RNG.normal(0, 0.3, size=(10, 2)) for c in centres])
    labels = row_of(spark, m).select(R.density_clusters(F.col("tokens"), 4, 3)).first()[0]
    assert len(set(labels)) == 3
    for b in range(3):
        assert len(set(labels[b * 10 : b * 10 + 10])) == 1
    merged = row_of(spark, m).select(R.cluster_merge(F.col("tokens"), 4, 3)).first()[0]
    assert sorted(s for _, s, _ in merged) == [10.0, 10.0, 10.0]
    for p, s, v in merged:
        assert v == pytest.approx(m[p // 10 * 10 : p // 10 * 10 + 10].sum(0) / (10 + 1e-6))
    mixed = row_of(spark, m).select(R.centre_weighted_merge(F.col("tokens"), 4, 3, 0.6)).first()[0]
    for p, s, v in mixed:
        others = [i for i in range(p // 10 * 10, p // 10 * 10 + 10) if i != p]
        assert s == 10 and v == pytest.approx(0.6 * m[p] + 0.4 * m[others].mean(0))


def test_static_windows_against_every_partition(spark):
    rng = np.random.default_rng(3)
    for _ in range(10):
        n, longest = 7, 4
        m = rng.random((n, 5))

        def saved(cuts):
            ends = [*cuts[1:], n]
            return sum(int((m[a : b - 1] > 0.4).all(axis=0).sum()) * (b - 1 - a) for a, b in zip(cuts, ends) if b - a > 1)

        best = 0
        for mask in range(2 ** (n - 1)):
            cuts = [0] + [i + 1 for i in range(n - 1) if mask >> i & 1]
            if max(np.diff([*cuts, n])) <= longest:
                best = max(best, saved(cuts))
        row = spark.createDataFrame([(m.tolist(),)], "likeness array<array<double>>")
        assert saved(row.select(R.static_windows(F.col("likeness"), 0.4, longest)).first()[0]) == best


def test_sequences_hold_at_most_their_length(spark):
    table = matrix_table(spark, RNG.normal(size=(23, 3))).repartition(4)
    packed = R.pack_sequences(table, "row_id", 10, "w", F.col("row_id").cast("double")).orderBy("seq").collect()
    assert [len(r["tokens"]) for r in packed] == [10, 10, 3]
    assert packed[1]["scores"] == [float(i) for i in range(10, 20)]


# --- methods ---------------------------------------------------------------------------------

def test_methods_against_numpy(spark):
    from tiltmeter.operators import methods as M

    w, x = RNG.normal(size=(10, 16)), RNG.normal(size=(60, 16)) * np.linspace(0.2, 4, 16)
    weights = matrix_table(spark, w)
    activations = spark.createDataFrame([(i // 20, [float(v) for v in r]) for i, r in enumerate(x)], "batch long, x array<double>")

    def run(name, **kwargs):
        rows = M.quantise_weights(name, weights, activations, 8).orderBy("row_id").collect()
        return np.array([r["w"] for r in rows])

    def nearest(m):
        out = np.empty_like(m)
        for r in range(len(m)):
            for g in range(0, m.shape[1], 8):
                out[r, g : g + 8] = snap4(m[r, g : g + 8], *params4(m[r, g : g + 8]))
        return out

    assert run("full_precision") == pytest.approx(w)
    assert run("rtn_w4") == pytest.approx(nearest(w))
    losses = {}
    act = np.mean([np.abs(x[b * 20 : b * 20 + 20]).mean(0) for b in range(3)], axis=0)
    rel = np.mean([np.concatenate([np.abs(r[g : g + 8]) / np.abs(r[g : g + 8]).max() for g in (0, 8)]) for r in w], axis=0)
    for step in range(20):
        s = np.maximum(act ** (step / 20) / rel ** (1 - step / 20), 1e-4)
        s = s / np.sqrt(s.max() * s.min())
        q = nearest(w * s) / s
        losses[step] = (((x @ (q - w).T) ** 2).sum(), q)
    best = min(losses, key=lambda k: (losses[k][0], k))
    assert run("awq_w4") == pytest.approx(losses[best][1])
    exact = np.abs(x).max(0) >= 6
    assert exact.any() and not exact.all()
    assert (run("llmint8_w4")[:, exact] == w[:, exact]).all()
    rows = np.array([snap4(r, *params4(r)) for r in w])
    columns = np.array([snap4(c, *params4(c)) for c in w.T]).T
    better = min((rows, columns), key=lambda q: ((x @ (q - w).T) ** 2).sum())
    assert run("adadim_w4") == pytest.approx(better)
    gap = lambda q: ((x @ (q - w).T) ** 2).sum()
    assert gap(run("gptq_w4")) < 1.05 * gap(run("rtn_w4"))


def test_method_ids_and_seeds():
    from tiltmeter.operators import methods as M

    assert M.expand([{"method": "rtn"}, {"method": "awq", "method_id": "awq_w3"}, {"method": "none"}]) == [
        ("rtn", "rtn_w4", 4), ("rtn", "rtn_w6", 6), ("rtn", "rtn_w8", 8), ("awq", "awq_w3", 3),
    ]
    assert M.bits_of("full_precision") is None
    seeds = M.draw_seeds(42, 50)
    assert len(set(seeds)) == 50 and seeds[:3] == M.draw_seeds(42, 3) and max(seeds) < 2**31
    with pytest.raises(ValueError):
        M.draw_seeds(1, 0)
    with pytest.raises(ValueError, match="exists"):
        M.method("rtn")(lambda *a: None)


def test_layers_left_out_keep_their_weights(spark):
    from tiltmeter.operators import methods as M

    w = RNG.normal(size=(8, 16))
    table = matrix_table(spark, w).withColumn("block", F.col("row_id")).withColumn("layer", F.concat(F.lit("l"), F.col("row_id").cast("string")))
    x = spark.createDataFrame([(0, [float(v) for v in r]) for r in RNG.normal(size=(30, 16)) * np.linspace(0.1, 9, 16)], "batch long, x array<double>")
    for name in ("awq_w4", "rtn_w4"):
        got = {r["row_id"]: r["w"] for r in M.quantise_weights(name, table, x, 8, left_out=["0-3", "5", "l6"]).collect()}
        alone = {r["row_id"]: r["w"] for r in M.quantise_weights(name, table.where("row_id in (4, 7)"), x, 8).collect()}
        assert len(got) == 8 and all(got[i] == w[i].tolist() for i in (0, 1, 2, 3, 5, 6))
        assert all(got[i] == pytest.approx(alone[i]) and got[i] != w[i].tolist() for i in (4, 7))


def test_matrices_meet_ids_of_any_size(spark):
    ids, w = [-5, 9000, 2**50], RNG.normal(size=(3, 4))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, w)], "row_id long, delta array<double>")
    x = RNG.normal(size=(9, 4))
    got = G.output_error(table, G.gram(matrix_table(spark, x, "x"))).first()["loss"]
    assert got == pytest.approx(((w @ x.T) ** 2).sum())
