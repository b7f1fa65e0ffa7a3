"""Registered queries over two-parameter grids judged by the layer output."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions.prob import total
from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import clipping as L
from tiltmeter.operators import gram as G
from tiltmeter.operators import grids as N
from tiltmeter.operators import rounding as P
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.kernel_queries import _GRAM_BY_LABEL, _both_by_label, _codes_sql, _params_sql
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.sql import WEIGHTS, rnd, with_tables

W4 = IntFormat(4)
STEPS = 12
WIDER = 20
ROW_STEPS = 24

_SHIFTED = f"""
mid AS (SELECT label, pos, (min(v) + max(v)) * {WIDER} / 2.0 AS c, (max(v) - min(v)) * {WIDER} / 2.0 AS reach FROM w GROUP BY label, pos),
x AS (SELECT label, row_id, pos, v * {WIDER} - c AS v FROM w JOIN mid USING (label, pos)),
h AS (SELECT a.label, a.pos AS i, b.pos AS j, sum(a.v * b.v) AS h FROM x a JOIN x b USING (row_id) GROUP BY a.label, a.pos, b.pos),
tops AS (SELECT label, max(reach) AS top, CASE WHEN max(reach) < 1 THEN 0 ELSE greatest({STEPS}, floor(max(reach) / 0.5)) END::BIGINT AS n FROM mid GROUP BY label),
bounds AS (SELECT label, step::INT AS step, top - CASE WHEN n > 0 THEN step * (top - 1) / n ELSE 0 END AS bound FROM (SELECT *, unnest(range(0, n + 1)) AS step FROM tops)),
cand AS (SELECT label, step, bound, pos, greatest(1.0, reach / bound) AS s FROM bounds JOIN mid USING (label)),
sc AS (SELECT label, row_id, step, pos, pos // 16 AS grp, w.v AS x, w.v * c.s AS v, c.s AS cs FROM w JOIN cand c USING (label, pos)),"""


@query(
    "shifted_range_by_label",
    with_tables(WEIGHTS, _SHIFTED.rstrip(","))
    + ","
    + _params_sql("sc", "row_id, step, grp")
    + f""",
d AS (SELECT label, row_id, step, pos, ({_codes_sql()} - z) * s / cs - x AS d FROM sc JOIN p USING (row_id, step, grp)),
dd AS (SELECT a.label, step, a.pos AS i, b.pos AS j, sum(a.d * b.d) AS dd FROM d a JOIN d b USING (row_id, step) GROUP BY ALL),
losses AS (SELECT label, step, sum(dd * h) AS loss FROM dd JOIN h USING (label, i, j) GROUP BY label, step),
best AS (SELECT label, arg_min(step, (loss, step)) AS step, min(loss) AS loss FROM losses GROUP BY label)
SELECT label, step, {rnd("any_value(bound)")} AS bound, {rnd("sum(s)")} AS s_sum, {rnd("any_value(loss)", 4)} AS loss
FROM best JOIN cand USING (label, step) GROUP BY label, step""",
)
def shifted_range_by_label(spark, sf_dir):
    """Columns moved to their middle, then the best common range of each of ten matrices."""
    weights, x = _both_by_label(spark, sf_dir)
    wide = x.withColumn("x", F.transform("x", lambda v: v * WIDER))
    out = N.best_shifted_range(weights, wide, W4, X.GROUP, STEPS, keys=["label"])
    return out.select("label", "step", r9("bound").alias("bound"), r9(total(F.col("s"))).alias("s_sum"), r9("loss", 4).alias("loss"))


@query(
    "shift_bias",
    with_tables(WEIGHTS)
    + f""", mid AS (SELECT label, pos, (min(v) + max(v)) / 2 AS c FROM w GROUP BY label, pos)
SELECT label, row_id, {rnd("sum(v * c)")} AS bias FROM w JOIN mid USING (label, pos) GROUP BY label, row_id""",
)
def shift_bias(spark, sf_dir):
    """What the bias of every weight row gains from the shift of its matrix."""
    weights, x = _both_by_label(spark, sf_dir)
    return N.shift_bias(weights, N.shift_profile(x, keys=["label"]), ["label"]).select("label", "row_id", r9("bias").alias("bias"))


def _held(end: str, other: str) -> str:
    """The end of a range after all clamps so far: shares fall, so ends on the far side of zero stay at the first."""
    first, now = "(1.02::DOUBLE - 1 / 20.0::DOUBLE * 0.22::DOUBLE)", "(1.02::DOUBLE - (i + 1) / 20.0::DOUBLE * 0.22::DOUBLE)"
    return f"CASE WHEN {end} {other} 0 THEN {end} * {first} ELSE {end} * {now} END"


_NESTED = f"""
ends AS (SELECT label, row_id, pos // 16 AS grp, min(v) AS mn, max(v) AS mx FROM w GROUP BY ALL),
cl AS (SELECT w.label, w.row_id, pos // 16 AS grp, pos, i AS step, w.v AS x, least({_held("mx", "<")}, greatest({_held("mn", ">")}, w.v)) AS v
  FROM w JOIN ends e ON e.row_id = w.row_id AND e.grp = w.pos // 16, (SELECT unnest(range(0, 20))::INT AS i)),
{_params_sql("cl", "row_id, step, grp")},
d AS (SELECT label, row_id, step, grp, pos, s, z, ({_codes_sql()} - z) * s - x AS d FROM cl JOIN p USING (row_id, step, grp)),
l AS (SELECT a.row_id, a.grp, a.step, any_value(a.s) AS s, any_value(a.z) AS z, sum(a.d * b.d * h.h) AS loss
  FROM d a JOIN d b USING (row_id, step, grp) JOIN h ON h.label = a.label AND h.i = a.pos AND h.j = b.pos GROUP BY a.row_id, a.grp, a.step),
first AS (SELECT row_id, grp, arg_min(s, (loss, step)) AS s, arg_min(z, (loss, step)) AS z FROM l GROUP BY row_id, grp),
outs AS (SELECT row_id, k, greatest(max(abs(v)) * least(1.0::DOUBLE, 1.02::DOUBLE - (k + 1) / {ROW_STEPS}.0::DOUBLE * 0.82::DOUBLE), 1e-5) / 127.0 AS o
  FROM w, (SELECT unnest(range(0, {ROW_STEPS}))::INT AS k) GROUP BY row_id, k),
times AS (SELECT row_id, k, grp, o, z, greatest(1.0, round_even(s / o, 0)::DOUBLE) AS m, least(15.0, z + round_even(127.0 / o, 0)::DOUBLE) AS top,
  greatest(0.0, z - round_even(127.0 / o, 0)::DOUBLE) AS bottom FROM outs JOIN first USING (row_id)),
coded AS (SELECT w.label, w.row_id, k, w.pos, v, o, m, z, greatest(bottom, least(top, round_even(v / (m * o), 0)::DOUBLE + z)) AS q
  FROM w JOIN times t ON t.row_id = w.row_id AND t.grp = w.pos // 16),
e AS (SELECT label, row_id, k, pos, q, o, m, (q - z) * (m * o) - v AS d FROM coded),
ll AS (SELECT a.row_id, a.k, sum(a.d * b.d * h.h) AS loss FROM e a JOIN e b USING (row_id, k) JOIN h ON h.label = a.label AND h.i = a.pos AND h.j = b.pos GROUP BY a.row_id, a.k),
best AS (SELECT row_id, arg_min(k, (loss, k)) AS k, min(loss) AS loss FROM ll GROUP BY row_id)"""


@query(
    "nested_scales_by_label",
    with_tables(WEIGHTS, _GRAM_BY_LABEL, _NESTED)
    + f""" SELECT label, row_id, {rnd("any_value(o)", 12)} AS outer_scale, string_agg(m::BIGINT, ',' ORDER BY pos) FILTER (pos % 16 = 0) AS inner_scales,
  sum(q)::BIGINT AS codes, {rnd("any_value(loss)", 7)} AS loss FROM e JOIN best USING (row_id, k) GROUP BY label, row_id""",
)
def nested_scales_by_label(spark, sf_dir):
    """Integer scales of groups inside one scale per row, ten matrices at once."""
    weights, x = _both_by_label(spark, sf_dir)
    out = N.nested_scales(weights, G.gram(x, keys=["label"]), W4, X.GROUP, ["label"], row_steps=ROW_STEPS)
    codes = F.aggregate("codes", F.lit(0).cast("bigint"), lambda s, q: s + q)
    return out.select(
        "label", "row_id", r9("outer", 12).alias("outer_scale"), F.array_join(F.col("inner").cast("array<string>"), ",").alias("inner_scales"), codes.alias("codes"), r9("loss", 7).alias("loss")
    )


@query("learned_clipping_by_label")
def learned_clipping_by_label(spark, sf_dir):
    """Ranges learned by gradient descent, ten matrices at once: the error at the start and at the end of each row."""
    weights, x = _both_by_label(spark, sf_dir)
    out = L.learned_clipping(weights, G.gram(x, keys=["label"]), W4, X.GROUP, ["label"])
    return out.select("label", "row_id", r9("first_loss", 6).alias("first_loss"), r9("loss", 6).alias("loss"), r9(total(F.col("w")), 6).alias("row_sum"))


@query("progressive_rounding_by_label")
def progressive_rounding_by_label(spark, sf_dir):
    """Rounding decided a share at a time, ten matrices at once."""
    weights, x = _both_by_label(spark, sf_dir)
    out = P.progressive_rounding(weights, G.gram(x, keys=["label"]), W4, X.GROUP, ["label"], (0.4, 0.1, 0.0))
    return out.select("label", "row_id", r9("loss", 6).alias("loss"), r9(total(F.col("snapped")), 6).alias("row_sum"))
