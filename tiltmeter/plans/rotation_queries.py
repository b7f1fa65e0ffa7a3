"""Registered queries over turned weight and activation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.functions.vectors import absolute_max, dot
from tiltmeter.operators import quantize as Q
from tiltmeter.operators import rotate as R
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.kernel_queries import _codes_sql, _params_sql
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.sql import WEIGHTS, h, rnd, with_tables

W4 = IntFormat(4)
WIDTH = 64
SEED = 5
STEPS = 4

_TURNED = f"""
signs AS (SELECT i::INT AS pos, 1.0::DOUBLE - 2 * ({h("'5'", "i::VARCHAR", "'sign'")} % 2) AS s FROM (SELECT unnest(range(0, 64)) AS i)),
q AS (SELECT a.pos AS i, b.pos AS j, a.s * (CASE WHEN bit_count(a.pos & b.pos) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) / 8 AS q FROM signs a, signs b),
t AS (SELECT row_id, label, j AS pos, sum(v * q) AS v FROM w JOIN q ON q.i = w.pos GROUP BY row_id, label, j)"""


def _worst_sql(source: str, name: str) -> str:
    """CTE of the mean squared rounding error and the peak of each row."""
    body = _params_sql(source, "row_id").replace("p AS", f"p_{name} AS", 1)
    return f"""{body},
e_{name} AS (SELECT row_id, avg((({_codes_sql()} - z) * s - v) * (({_codes_sql()} - z) * s - v)) AS mse, max(abs(v)) AS peak
             FROM {source} JOIN p_{name} USING (row_id) GROUP BY row_id)"""


@query(
    "rotated_weights",
    with_tables(WEIGHTS, _TURNED, _worst_sql("w", "plain"), _worst_sql("t", "turned"))
    + f""" SELECT a.row_id, {rnd("a.mse")} AS mse_plain, {rnd("b.mse", 7)} AS mse_turned, {rnd("a.peak")} AS peak_plain, {rnd("b.peak")} AS peak_turned
FROM e_plain a JOIN e_turned b USING (row_id)""",
)
def rotated_weights(spark, sf_dir):
    """Error of rounding to four bits per row, before and after the rotation, and the largest magnitude of both."""
    rows = X.weights(spark, sf_dir).select("row_id", "w", F.col("w").alias("t"))
    rows = R.rotate_rows(rows, "t", WIDTH, SEED)
    both = Q.round_rows(Q.round_rows(rows, W4, "w", out="qw"), W4, "t", out="qt")
    return both.select(
        "row_id",
        r9(Q.row_error(F.col("w"), F.col("qw"))).alias("mse_plain"),
        r9(Q.row_error(F.col("t"), F.col("qt")), 7).alias("mse_turned"),
        r9(absolute_max(F.col("w"))).alias("peak_plain"),
        r9(absolute_max(F.col("t"))).alias("peak_turned"),
    )


@query(
    "rotated_products",
    with_tables(WEIGHTS, _TURNED)
    + f""" SELECT a.row_id, {rnd("sum(a.v * b.v)")} AS plain, {rnd("sum(a.v * b.v)")} AS turned, {rnd("any_value(t.first)")} AS first_turned
FROM w a JOIN w b ON b.row_id = a.row_id + 1 AND a.pos = b.pos JOIN (SELECT row_id, v AS first FROM t WHERE pos = 0) t ON t.row_id = a.row_id GROUP BY a.row_id""",
)
def rotated_products(spark, sf_dir):
    """Each weight row times the next activation row: the same after both were turned."""
    rows = X.weights(spark, sf_dir)
    weights, x = rows.select("row_id", "w"), rows.select((F.col("row_id") - 1).alias("row_id"), F.col("w").alias("x"))
    w, a = R.rotate_pair(weights.withColumn("w0", F.col("w")), x.withColumn("x0", F.col("x")), WIDTH, SEED)
    return w.join(a, "row_id").select(
        "row_id", r9(dot(F.col("w0"), F.col("x0"))).alias("plain"), r9(dot(F.col("w"), F.col("x"))).alias("turned"), r9(F.get("w", F.lit(0))).alias("first_turned")
    )


def _reflections_sql() -> str:
    share = lambda tag: f"(({h(chr(39) + str(SEED) + chr(39), 'k::VARCHAR', 'i::VARCHAR', chr(39) + tag + chr(39))}) + 0.5::DOUBLE) / {1 << 60}.0::DOUBLE"
    out = f"""
u AS (SELECT k, i::INT AS pos, sqrt(-2 * ln({share("r")})) * cos(2 * pi() * {share("a")}) AS u
      FROM (SELECT unnest(range(1, {STEPS + 1})) AS k), (SELECT unnest(range(0, 64)) AS i)),
t0 AS (SELECT row_id, pos, v FROM w)"""
    for k in range(1, STEPS + 1):
        out += f""",
t{k} AS (SELECT row_id, pos, v - 2 * sum(v * u) OVER (PARTITION BY row_id) / sum(u * u) OVER (PARTITION BY row_id) * u AS v
         FROM t{k - 1} JOIN u USING (pos) WHERE u.k = {k})"""
    return out


@query(
    "reflected_weights",
    with_tables(WEIGHTS, _reflections_sql())
    + f""" SELECT row_id, {rnd("sum(v)", 8)} AS row_sum, {rnd("sum(v * v)", 8)} AS squares, {rnd("max(abs(v))", 8)} AS peak FROM t{STEPS} GROUP BY row_id""",
)
def reflected_weights(spark, sf_dir):
    """The random mode: rows after some reflections. Their length is kept."""
    rows = R.reflect_rows(X.weights(spark, sf_dir), "w", WIDTH, STEPS, SEED)
    total = F.aggregate("w", F.lit(0.0), lambda s, v: s + v)
    return rows.select("row_id", r9(total, 8).alias("row_sum"), r9(dot(F.col("w"), F.col("w")), 8).alias("squares"), r9(absolute_max(F.col("w")), 8).alias("peak"))
