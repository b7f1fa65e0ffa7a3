"""Registered queries over dense grids with sparse outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions.prob import total
from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import gram as G
from tiltmeter.operators import outliers as O
from tiltmeter.operators.factors import inverse_factors
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.kernel_queries import _codes_sql, _both_by_label
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.sql import WEIGHTS, rnd, with_tables

W4 = IntFormat(4)
RELATIVE = 0.02


def _param_sql(name: str) -> str:
    """A group parameter on the unrounded three-bit grid of its sixteen rows."""
    step = f"greatest(max({name}) OVER g - min({name}) OVER g, 1e-5) / 7.0"
    zero = f"(0.0 - min({name}) OVER g / ({step}))"
    return f"(greatest(0.0, least(7.0, round_even({name} / greatest({step}, 1e-9) + {zero}, 0)::DOUBLE)) - {zero}) * ({step})"


_OUTLIERS = f"""
u AS (SELECT label, pos, 1 / sqrt(sum(v * v)) AS d, var_samp(v) AS spread FROM w GROUP BY label, pos),
th AS (SELECT label, {RELATIVE}::DOUBLE * avg(spread / (d * d)) AS t FROM u GROUP BY label),
c AS (SELECT w.*, pos // 16 AS grp, d, t FROM w JOIN u USING (label, pos) JOIN th USING (label)),
sides AS (
  SELECT a.row_id, a.grp, a.pos AS gone, min(b.v) AS lo, max(b.v) AS hi FROM c a JOIN c b USING (row_id, grp) WHERE a.pos <> b.pos GROUP BY ALL
  UNION ALL SELECT row_id, grp, -1, min(v), max(v) FROM c GROUP BY row_id, grp),
grids AS (SELECT *, 0.0 - lo / s AS z FROM (SELECT *, greatest(hi - lo, 1e-5) / 15.0 AS s FROM sides)),
errors AS (SELECT row_id, grp, gone, sum(((({_codes_sql("loose")}) - z) * s - v) / d * ((({_codes_sql("loose")}) - z) * s - v) / d) AS e
  FROM grids JOIN c USING (row_id, grp) WHERE pos <> gone GROUP BY ALL),
marked AS (SELECT c.*, b.e - l.e > t AS cand FROM c JOIN errors l ON l.row_id = c.row_id AND l.gone = c.pos AND l.grp = c.grp
  JOIN errors b ON b.row_id = c.row_id AND b.grp = c.grp AND b.gone = -1),
filled AS (SELECT *, CASE WHEN cand THEN coalesce(sum(CASE WHEN NOT cand THEN v END) OVER g, 0) / greatest(count(*) FILTER (NOT cand) OVER g, 1) ELSE v END AS f
  FROM marked WINDOW g AS (PARTITION BY row_id, grp)),
first AS (SELECT *, greatest(0.0, least(15.0, 0.0 - round_even(lo / s, 0)::DOUBLE)) AS z FROM (
  SELECT label, row_id, grp, min(f) AS lo, greatest(max(f) - min(f), 1e-5) / 15.0 AS s FROM filled GROUP BY ALL)),
p AS (SELECT row_id, grp, {_param_sql("s")} AS s, {_param_sql("z")} AS z FROM first WINDOW g AS (PARTITION BY label, row_id // 16, grp)),
judged AS (SELECT c.label, row_id, pos, v, t, ({_codes_sql()} - z) * s AS q, pow((v - ({_codes_sql()} - z) * s) / d, 2) AS e FROM c JOIN p USING (row_id, grp))"""


@query(
    "outlier_groups",
    with_tables(WEIGHTS, _OUTLIERS)
    + f""" SELECT label, row_id, coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (e > t), '') AS outliers, {rnd("sum(CASE WHEN e > t THEN 0 ELSE e END)", 7)} AS loss,
  {rnd("sum(CASE WHEN e > t THEN v ELSE q END)", 7)} AS row_sum FROM judged GROUP BY label, row_id""",
)
def outlier_groups(spark, sf_dir):
    """Per label and row the weights kept as they are, with the column units of diagonal second moments."""
    rows = X.weights(spark, sf_dir)
    cells = rows.select("label", F.posexplode("w").alias("pos", "x")).groupBy("label", "pos").agg((1 / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("d"))
    units = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("c")).select("label", F.transform("c", lambda c: c["d"]).alias("d"))
    out = O.outlier_groups(rows, units, W4, X.GROUP, RELATIVE, keys=["label"])
    return out.select("label", "row_id", F.array_join(F.col("outliers").cast("array<string>"), ",").alias("outliers"), r9("loss", 7).alias("loss"), r9(total(F.col("w")), 7).alias("row_sum"))


@query("outlier_feedback")
def outlier_feedback(spark, sf_dir):
    """The same with error feedback, a factored matrix per label."""
    weights, x = _both_by_label(spark, sf_dir)
    factor = inverse_factors(G.pitched_hessian(x, "batch", keys=["label"]), damping=1.0, keys=["label"], tile=X.GROUP)
    out = O.outlier_feedback(weights, factor, W4, X.GROUP, RELATIVE, keys=["label"])
    return out.select("label", "row_id", F.size("outliers").alias("n_outliers"), r9("loss", 6).alias("loss"), r9(total(F.col("w")), 6).alias("row_sum"))
