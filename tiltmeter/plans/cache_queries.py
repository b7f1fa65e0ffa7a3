"""Registered queries over key caches and tuned norms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions.prob import total
from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.functions.vectors import dot
from tiltmeter.operators import keycache as C
from tiltmeter.operators import norms as N
from tiltmeter.operators import quantize as Q
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.kernel_queries import _codes_sql, _params_sql
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.selector_queries import _TOKENS, _sequences
from tiltmeter.plans.sql import WEIGHTS, rnd, with_tables
from tiltmeter.session import settle

W4 = IntFormat(4)
SIZE, WHOLE, FETCHED = 5, 2, 3
SINKS, WINDOW, INCOMING, TURNED = 4, 24, 6, 48
RATE, STEPS = 0.5, 3
RANKS = (8, 16, 32, 64)


@query(
    "outlier_chunks",
    with_tables(_TOKENS)
    + f""",
long AS (SELECT seq, pos, pos // {SIZE} AS chunk, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM tok JOIN full_len USING (seq) WHERE pos // {SIZE} < n // {SIZE}),
mark AS (SELECT seq, chunk, d, avg(x) AS m FROM long GROUP BY ALL),
alike AS (SELECT seq, chunk, pos, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS c FROM long JOIN mark USING (seq, chunk, d) GROUP BY ALL),
least AS (SELECT seq, chunk, min(c) AS c FROM alike GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY c, chunk) AS rn FROM least),
q AS (SELECT seq, unnest(v) AS qx, generate_subscripts(v, 1) AS d FROM (SELECT seq, arg_max(v, pos) AS v FROM tok GROUP BY seq)),
sc AS (SELECT seq, chunk, sum(m * qx) AS sc FROM mark JOIN q USING (seq, d) JOIN ranked USING (seq, chunk) WHERE rn > {WHOLE} GROUP BY ALL),
best AS (SELECT seq, chunk FROM sc QUALIFY row_number() OVER (PARTITION BY seq ORDER BY sc DESC, chunk) <= {FETCHED})
SELECT seq, coalesce((SELECT string_agg(chunk, ',' ORDER BY chunk) FROM ranked r WHERE r.seq = f.seq AND rn <= {WHOLE}), '') AS outliers,
  coalesce((SELECT string_agg(chunk, ',' ORDER BY chunk) FROM best b WHERE b.seq = f.seq), '') AS fetched FROM full_len f""",
)
def outlier_chunks(spark, sf_dir):
    """Two chunks of five tokens stay whole; the last token fetches three of the others by their marks."""
    rows = _sequences(spark, sf_dir).withColumn("index", C.chunk_index(F.col("tokens"), SIZE, WHOLE))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    fetched = C.fetched_chunks(F.col("index"), F.element_at("tokens", -1), FETCHED)
    return rows.select("seq", text(F.col("index.outliers")).alias("outliers"), text(fetched).alias("fetched"))


_ANGLE = f"power(10000.0::DOUBLE, -2.0 * (d % {TURNED // 2}) / {TURNED})"


@query(
    "moved_keys",
    with_tables(_TOKENS)
    + f""",
raw AS (SELECT seq, pos, unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INT AS d FROM tok WHERE pos < {WINDOW}),
size AS (SELECT seq, count(*) AS n FROM tok WHERE pos < {WINDOW} GROUP BY seq),
placed AS (SELECT *, CASE WHEN n + {INCOMING} < {WINDOW} OR pos < {SINKS} THEN pos ELSE pos - {INCOMING} END AS place
  FROM raw JOIN size USING (seq) WHERE n + {INCOMING} < {WINDOW} OR pos < {SINKS} OR pos >= {SINKS + INCOMING}),
turned AS (SELECT a.seq, a.place, a.d, CASE WHEN a.d >= {TURNED} THEN a.x ELSE a.x * cos(a.place * {_ANGLE.replace("d %", "a.d %")})
    + CASE WHEN a.d < {TURNED // 2} THEN -b.x ELSE b.x END * sin(a.place * {_ANGLE.replace("d %", "a.d %")}) END AS x
  FROM placed a LEFT JOIN placed b ON a.seq = b.seq AND a.pos = b.pos AND b.d = CASE WHEN a.d < {TURNED // 2} THEN a.d + {TURNED // 2} ELSE a.d - {TURNED // 2} END)
SELECT seq, count(DISTINCT place) AS n, {rnd("sum(x * (place + 1))", 7)} AS placed, {rnd("sum(x * x * (d + 1))", 7)} AS turned FROM turned GROUP BY seq""",
)
def moved_keys(spark, sf_dir):
    """A full cache of turned keys makes room for six more; what moves up is as if it had been turned there at once."""
    rows = _sequences(spark, sf_dir)
    cache = F.transform(F.slice("tokens", 1, WINDOW), lambda t, i: C.turned(t, i, TURNED))
    moved = rows.select("seq", C.moved_window(cache, SINKS, WINDOW, INCOMING, TURNED).alias("t"))
    placed = F.transform("t", lambda v, i: total(v) * (i + 1))
    squares = F.transform("t", lambda v: total(F.transform(v, lambda x, d: x * x * (d + 1))))
    return moved.select("seq", F.size("t").cast("bigint").alias("n"), r9(total(placed), 7).alias("placed"), r9(total(squares), 7).alias("turned"))


@query("low_rank_keys")
def low_rank_keys(spark, sf_dir):
    """Per label and rank the squares of the keys and what the directions leave out, from moments and from rebuilt keys."""
    rows = X.weights(spark, sf_dir).select("label", F.col("w").alias("x"))
    basis = settle(C.key_basis(rows, RANKS, keys=["label"]))
    gap = F.zip_with("x", "rebuilt", lambda a, b: a - b)
    seen = C.low_rank_keys(rows, basis, keys=["label"]).select("label", "rank", dot(F.col("x"), F.col("x")).alias("all"), gap.alias("gap"))
    seen = seen.groupBy("label", "rank").agg(F.sum("all").alias("squares"), F.sum(dot(F.col("gap"), F.col("gap"))).alias("rebuilt_lost"))
    out = basis.select("label", "rank", "lost").join(seen, ["label", "rank"])
    return out.select("label", "rank", r9("squares", 6).alias("squares"), r9("lost", 6).alias("lost"), r9("rebuilt_lost", 6).alias("rebuilt_lost"))


def _steps_sql() -> str:
    out = "s0 AS (SELECT *, 1.0::DOUBLE AS p, 0.0::DOUBLE AS o, count(*) OVER (PARTITION BY label) AS n FROM pairs)"
    for k in range(1, STEPS + 1):
        mean, std = "(p * qm + o - fm)", "(abs(p) * qs - fs)"
        out += f""",
s{k} AS (SELECT label, pos, fm, fs, qm, qs, n, p - {RATE} * 2 * ({mean} * qm + {std} * sign(p) * qs) / n AS p, o - {RATE} * 2 * {mean} / n AS o FROM s{k - 1})"""
    return out


@query(
    "norm_tuning",
    with_tables(WEIGHTS, _params_sql("w", "row_id"))
    + f""",
snapped AS (SELECT label, row_id, pos, ({_codes_sql()} - z) * s AS q, v FROM w JOIN p USING (row_id)),
pairs AS (SELECT label, pos, avg(v) AS fm, stddev_samp(v) AS fs, avg(q) AS qm, stddev_samp(q) AS qs FROM snapped GROUP BY label, pos),
{_steps_sql()}
SELECT label, {rnd("avg(power(qm - fm, 2) + power(qs - fs, 2))", 12)} AS before, {rnd("avg(power(p * qm + o - fm, 2) + power(abs(p) * qs - fs, 2))", 12)} AS after,
  {rnd("sum(p)")} AS pitches, {rnd("sum(o)")} AS offsets FROM s{STEPS} GROUP BY label""",
)
def norm_tuning(spark, sf_dir):
    """Rows rounded to four bits get back their channel moments step by step, a norm per label."""
    rows = X.weights(spark, sf_dir)
    snapped = Q.round_rows(rows, W4).select("label", F.col("snapped").alias("w"))
    out = N.tuned_norms(rows.select("label", "w"), snapped, "w", RATE, STEPS, ["label"])
    part = lambda name: r9(total(F.transform("norms", lambda n: n[name])))
    return out.select("label", r9("before", 12).alias("before"), r9("after", 12).alias("after"), part("pitch").alias("pitches"), part("offset").alias("offsets"))
