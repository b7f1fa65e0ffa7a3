"""Registered queries over weight and activation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions.prob import total
from tiltmeter.functions.quantmath import FLOAT_FORMATS, IntFormat
from tiltmeter.operators import evaluate as E
from tiltmeter.operators import gram as G
from tiltmeter.operators import methods as M
from tiltmeter.operators import prune as U
from tiltmeter.operators import quantize as Q
from tiltmeter.operators import ranges as N
from tiltmeter.operators.factors import inverse_factors
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.sql import WEIGHTS, rnd, with_tables

W4 = IntFormat(4)
W4_LOOSE = IntFormat(4, round_zero=False)
W4_SYM = IntFormat(4, symmetric=True)
W8_SYM = IntFormat(8, symmetric=True)
W8 = IntFormat(8)
GROUP = X.GROUP


def _params_sql(source: str, keys: str, kind: str = "asym", bits: int = 4) -> str:
    """CTE ``p`` with pitch s and zero z per key from the values v of ``source``."""
    top = 2**bits - 1
    if kind == "sym":
        half = 2 ** (bits - 1) - 1
        return f"p AS (SELECT {keys}, greatest(abs(max(v)), abs(min(v)), 1e-5) / {half}.0 AS s, 0.0::DOUBLE AS z FROM {source} GROUP BY {keys})"
    zero = (
        f"0.0 - lo / s"
        if kind == "loose"
        else f"greatest(0.0, least({top}.0, 0.0 - round_even(lo / s, 0)::DOUBLE))"
    )
    return f"""p AS (SELECT *, {zero} AS z FROM (
  SELECT {keys}, min(v) AS lo, greatest(max(v) - min(v), 1e-5) / {top}.0 AS s FROM {source} GROUP BY {keys}))"""


def _codes_sql(kind: str = "asym", bits: int = 4, v: str = "v") -> str:
    low, high = (f"-{2 ** (bits - 1)}", 2 ** (bits - 1) - 1) if kind == "sym" else ("0", 2**bits - 1)
    inner = (
        f"round_even({v} / greatest(s, 1e-9) + z, 0)::DOUBLE"
        if kind == "loose"
        else f"round_even({v} / s, 0)::DOUBLE + z"
    )
    return f"greatest({low}.0, least({high}.0, {inner}))"


_GROUPED = "g AS (SELECT row_id, label, pos // 16 AS grp, pos, v FROM w)"


def _rtn_sql(source: str, keys: str, kind: str = "asym", bits: int = 4, out: str | None = None) -> str:
    """Per key (and row) pitch, zero, sum of codes and mean squared error."""
    out = out or keys
    return f"""
{_params_sql(source, keys, kind, bits)},
c AS (SELECT t.*, p.s, p.z, {_codes_sql(kind, bits)} AS q FROM {source} t JOIN p USING ({keys}))
SELECT {out}, {rnd("any_value(s)")} AS pitch, {rnd("any_value(z)")} AS zero, sum(q)::BIGINT AS code_sum,
       {rnd("avg(((q - z) * s - v) * ((q - z) * s - v))")} AS mse
FROM c GROUP BY {out}"""


def _report(rows, *keys):
    return rows.select(
        *keys,
        r9("pitch").alias("pitch"),
        r9("zero").alias("zero"),
        total(F.col("codes")).cast("bigint").alias("code_sum"),
        r9(Q.row_error(F.col("v"), F.col("snapped"))).alias("mse"),
    )


@query("rtn_per_group", with_tables(WEIGHTS, _GROUPED) + "," + _rtn_sql("g", "row_id, grp"))
def rtn_per_group(spark, sf_dir):
    rows = Q.quantise(X.weights(spark, sf_dir), W4, group=GROUP)
    return _report(rows.withColumn("grp", F.col("group").cast("bigint")), "row_id", "grp")


@query("rtn_per_channel", with_tables(WEIGHTS) + "," + _rtn_sql("w", "row_id"))
def rtn_per_channel(spark, sf_dir):
    return _report(Q.quantise(X.weights(spark, sf_dir), W4), "row_id")


@query("qparams_sym", with_tables(WEIGHTS, _GROUPED) + "," + _rtn_sql("g", "row_id, grp", "sym", 8))
def qparams_sym(spark, sf_dir):
    rows = Q.quantise(X.weights(spark, sf_dir), W8_SYM, group=GROUP)
    return _report(rows.withColumn("grp", F.col("group").cast("bigint")), "row_id", "grp")


@query("unrounded_zero", with_tables(WEIGHTS, _GROUPED) + "," + _rtn_sql("g", "row_id, grp", "loose"))
def unrounded_zero(spark, sf_dir):
    rows = Q.quantise(X.weights(spark, sf_dir), W4_LOOSE, group=GROUP)
    return _report(rows.withColumn("grp", F.col("group").cast("bigint")), "row_id", "grp")


@query("rtn_per_tensor", with_tables(WEIGHTS, "t AS (SELECT *, 0 AS one FROM w)") + "," + _rtn_sql("t", "one", out="row_id"))
def rtn_per_tensor(spark, sf_dir):
    return _report(Q.quantise_tensor(X.weights(spark, sf_dir), W4), "row_id")


@query(
    "rtn_per_head",
    with_tables(WEIGHTS, "t AS (SELECT *, row_id // 50 AS head FROM w)") + "," + _rtn_sql("t", "head", out="row_id"),
)
def rtn_per_head(spark, sf_dir):
    return _report(Q.quantise_heads(X.weights(spark, sf_dir), W4, 50), "row_id")


@query(
    "rtn_per_block",
    with_tables(
        WEIGHTS,
        """padded AS (SELECT row_id, pos, v FROM w UNION ALL
  SELECT m + i, pos, 0.0 FROM (SELECT max(row_id) AS m FROM w), (SELECT unnest(range(1, 16)) AS i),
    (SELECT unnest(range(0, 64)) AS pos) WHERE (m + i) // 16 = m // 16),
t AS (SELECT row_id, row_id // 16 AS tile_row, pos // 16 AS grp, v FROM w),
p AS (SELECT *, greatest(0.0, least(15.0, 0.0 - round_even(lo / s, 0)::DOUBLE)) AS z FROM (
  SELECT tile_row, grp, min(abs(v)) AS lo, greatest(max(abs(v)) - min(abs(v)), 1e-5) / 15.0 AS s FROM t GROUP BY tile_row, grp)),
c AS (SELECT t.*, p.s, p.z, greatest(0.0, least(15.0, round_even(v / s, 0)::DOUBLE + z)) AS q FROM t JOIN p USING (tile_row, grp))""",
    )
    + f"""
SELECT row_id, grp, {rnd("any_value(s)")} AS pitch, {rnd("any_value(z)")} AS zero, sum(q)::BIGINT AS code_sum,
       {rnd("avg(((q - z) * s - v) * ((q - z) * s - v))")} AS mse
FROM c GROUP BY row_id, grp""",
)
def rtn_per_block(spark, sf_dir):
    rows = Q.quantise_tiles(X.weights(spark, sf_dir), W4, GROUP)
    return _report(rows.withColumn("grp", F.col("group").cast("bigint")), "row_id", "grp")


@query(
    "rtn_input_columns",
    with_tables(WEIGHTS)
    + ","
    + _params_sql("w", "pos")
    + f""",
c AS (SELECT w.*, p.s, p.z, {_codes_sql()} AS q FROM w JOIN p USING (pos))
SELECT row_id, sum(q)::BIGINT AS code_sum, {rnd("avg(((q - z) * s - v) * ((q - z) * s - v))")} AS mse
FROM c GROUP BY row_id""",
)
def rtn_input_columns(spark, sf_dir):
    rows = Q.quantise_input_columns(X.weights(spark, sf_dir), W4)
    return rows.select(
        "row_id",
        total(F.col("codes")).cast("bigint").alias("code_sum"),
        r9(Q.row_error(F.col("v"), F.col("snapped"))).alias("mse"),
    )


@query(
    "stored_codes",
    with_tables(WEIGHTS, _GROUPED)
    + ","
    + _params_sql("g", "row_id, grp", "sym", 4)
    + f""",
c AS (SELECT g.*, {_codes_sql("sym", 4)} AS q FROM g JOIN p USING (row_id, grp))
SELECT row_id, string_agg(q::INT::VARCHAR, ',' ORDER BY pos) AS codes FROM c GROUP BY row_id""",
)
def stored_codes(spark, sf_dir):
    """Real quantisation: codes of a whole row in their storage type."""
    rows = Q.round_rows(X.weights(spark, sf_dir), W4_SYM, group=GROUP, out="codes", codes=True)
    return Q.stored_codes(rows, W4_SYM).select("row_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query(
    "mixed_columns",
    with_tables(WEIGHTS)
    + """,
o AS (SELECT pos, max(abs(v)) >= 0.4 AS exact FROM w GROUP BY pos),"""
    + _params_sql("w", "row_id")
    + f""",
c AS (SELECT w.*, o.exact, p.s, p.z, {_codes_sql()} AS q FROM w JOIN p USING (row_id) JOIN o USING (pos))
SELECT row_id, {rnd("sum(CASE WHEN exact THEN v ELSE (q - z) * s END)")} AS row_sum,
       count_if(exact)::BIGINT AS n_exact FROM c GROUP BY row_id""",
)
def mixed_columns(spark, sf_dir):
    """Columns with large values stay exact, the others are quantised per row."""
    weights = X.weights(spark, sf_dir)
    exact = (
        Q.outlier_columns(weights, 0.4, "w")
        .where("is_outlier")
        .agg(F.array_sort(F.collect_list("pos")).alias("exact"))
    )
    rows = Q.attach(Q.quantise(weights, W4), exact)
    mixed = rows.withColumn("mixed", Q.keep_columns(F.col("snapped"), F.col("v"), F.col("exact")))
    return mixed.select(
        "row_id", r9(total(F.col("mixed"))).alias("row_sum"), F.size("exact").cast("bigint").alias("n_exact")
    )


@query(
    "learned_rounding",
    with_tables(WEIGHTS)
    + ","
    + _params_sql("w", "row_id")
    + f""",
c AS (SELECT w.*, p.s, p.z, greatest(0.0, least(15.0, floor(v / s) + ((row_id + pos) % 2)::DOUBLE + z)) AS q FROM w JOIN p USING (row_id))
SELECT row_id, sum(q)::BIGINT AS code_sum, {rnd("avg(((q - z) * s - v) * ((q - z) * s - v))")} AS mse FROM c GROUP BY row_id""",
)
def learned_rounding(spark, sf_dir):
    """Static pitches with a given floor-or-ceiling choice per weight."""
    rows = Q.quantise(X.weights(spark, sf_dir), W4).drop("codes", "snapped")
    choice = F.transform("v", lambda x, i: ((F.col("row_id") + i) % 2).cast("double"))
    out = Q.quantise_static(rows.withColumn("learned", choice), W4, "learned")
    return out.select(
        "row_id",
        total(F.col("codes")).cast("bigint").alias("code_sum"),
        r9(Q.row_error(F.col("v"), F.col("snapped"))).alias("mse"),
    )


@query(
    "learnable_range",
    with_tables(WEIGHTS)
    + f""",
r AS (SELECT row_id, min(v) / (1 + exp(-(row_id % 5)::DOUBLE)) AS lo, max(v) / (1 + exp(-4.0)) AS hi FROM w GROUP BY row_id),
p AS (SELECT *, greatest(0.0, least(15.0, 0.0 - round_even(lo / s, 0)::DOUBLE)) AS z
      FROM (SELECT *, greatest(hi - lo, 1e-5) / 15.0 AS s FROM r)),
c AS (SELECT w.*, p.s, p.z, {_codes_sql()} AS q FROM w JOIN p USING (row_id))
SELECT row_id, {rnd("any_value(s)")} AS pitch, {rnd("any_value(z)")} AS zero, sum(q)::BIGINT AS code_sum,
       {rnd("avg(((q - z) * s - v) * ((q - z) * s - v))")} AS mse FROM c GROUP BY row_id""",
)
def learnable_range(spark, sf_dir):
    rows = Q.group_rows(X.weights(spark, sf_dir), "w", None, ["row_id"])
    shrunk = Q.learnable_range(rows, W4, (F.col("row_id") % 5).cast("double"), F.lit(4.0))
    return _report(Q.apply_format(shrunk, W4), "row_id")


def _float_sql(e: int, m: int) -> str:
    return f"""
r AS (SELECT row_id, greatest(max(v), -min(v)) AS reach FROM w GROUP BY row_id),
b AS (SELECT *, {2.0**e} - log2(reach) + log2({2.0 - 2.0**-m}) - 1 AS bias FROM r),
st AS (SELECT w.*, power(2.0, greatest(floor(CASE WHEN v = 0 THEN NULL ELSE log2(abs(greatest(least(v, reach), -reach))) END + bias), 1.0) - {m} - bias) AS step,
         greatest(least(v, reach), -reach) AS x FROM w JOIN b USING (row_id))
SELECT row_id, {rnd("sum(round_even(x / step, 0)::DOUBLE * step)")} AS row_sum,
       {rnd("avg((round_even(x / step, 0)::DOUBLE * step - v) * (round_even(x / step, 0)::DOUBLE * step - v))")} AS mse
FROM st GROUP BY row_id"""


def _float_query(name: str):
    fmt = FLOAT_FORMATS[name]

    @query(f"float_{name}", with_tables(WEIGHTS) + "," + _float_sql(fmt.exponent_bits, fmt.mantissa_bits))
    def run(spark, sf_dir):
        rows = Q.quantise_float(X.weights(spark, sf_dir), fmt)
        return rows.select(
            "row_id",
            r9(total(F.col("snapped"))).alias("row_sum"),
            r9(Q.row_error(F.col("v"), F.col("snapped"))).alias("mse"),
        )


for _name in FLOAT_FORMATS:
    _float_query(_name)


@query(
    "two_step_4_8",
    with_tables(WEIGHTS)
    + ","
    + _params_sql("w", "row_id", "sym", 8).replace("p AS", "p8 AS", 1)
    + f""",
c8 AS (SELECT row_id, pos // 16 AS grp, w.v AS x, p8.s AS s8, {_codes_sql("sym", 8)} AS v FROM w JOIN p8 USING (row_id)),
"""
    + _params_sql("c8", "row_id, grp")
    + f""",
c4 AS (SELECT c8.*, p.s, p.z, {_codes_sql()} AS q FROM c8 JOIN p USING (row_id, grp))
SELECT row_id, grp, {rnd("any_value(s)")} AS pitch, {rnd("any_value(z)")} AS zero, sum(q)::BIGINT AS code_sum,
       {rnd("sum((q - z) * s * s8)")} AS value_sum FROM c4 GROUP BY row_id, grp""",
)
def two_step_4_8(spark, sf_dir):
    rows = Q.quantise_two_step(X.weights(spark, sf_dir), W8_SYM, W4, GROUP)
    return rows.select(
        "row_id",
        F.col("group").cast("bigint").alias("grp"),
        r9("pitch").alias("pitch"),
        r9("zero").alias("zero"),
        total(F.col("codes")).cast("bigint").alias("code_sum"),
        r9(total(F.col("snapped"))).alias("value_sum"),
    )


@query(
    "kv_calibrated",
    with_tables(WEIGHTS)
    + """,
cal AS (SELECT label, v FROM w WHERE row_id % 4 = 0),"""
    + _params_sql("cal", "label", "asym", 8)
    + f""",
c AS (SELECT w.*, p.s, p.z, {_codes_sql("asym", 8)} AS q FROM w JOIN p USING (label))
SELECT row_id, {rnd("any_value(s)")} AS pitch, {rnd("any_value(z)")} AS zero, sum(q)::BIGINT AS code_sum,
       {rnd("avg(((q - z) * s - v) * ((q - z) * s - v))")} AS mse FROM c GROUP BY row_id""",
)
def kv_calibrated(spark, sf_dir):
    """Cache states quantised with the range of the calibration states of their layer (here the label)."""
    rows = Q.group_rows(X.weights(spark, sf_dir), "w", None, ["row_id", "label"])
    calibration = rows.where("row_id % 4 = 0")
    return _report(Q.calibrated(rows, calibration, W8, ["label"]), "row_id")


@query(
    "kv_residual_window",
    with_tables(WEIGHTS)
    + ","
    + _params_sql("w", "row_id", "asym", 8)
    + f""",
n AS (SELECT row_id // 50 AS seq, count(DISTINCT row_id) AS n FROM w GROUP BY seq),
c AS (SELECT w.row_id, w.v, row_id % 50 >= n - greatest(n - 20, 0) % 8 AS exact, ({_codes_sql("asym", 8)} - z) * s AS y
      FROM w JOIN p USING (row_id) JOIN n ON seq = row_id // 50)
SELECT row_id, any_value(exact) AS exact, {rnd("sum(CASE WHEN exact THEN v ELSE y END)")} AS row_sum FROM c GROUP BY row_id""",
)
def kv_residual_window(spark, sf_dir):
    """Cache states of sequences of fifty tokens: a prompt of twenty, then windows of eight that wait until they are full."""
    rows = X.weights(spark, sf_dir).withColumn("seq", F.floor(F.col("row_id") / 50))
    lengths = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    cached = Q.round_rows(rows, W8).join(lengths, "seq")
    exact = Q.stays_exact(F.col("row_id") % 50, F.col("n"), 20, 8)
    kept = F.when(exact, F.col("w")).otherwise(F.col("snapped"))
    return cached.select("row_id", exact.alias("exact"), r9(total(kept)).alias("row_sum"))


# --- ranges ----------------------------------------------------------------------------------

@query(
    "mse_range",
    with_tables(WEIGHTS, _GROUPED)
    + f""",
r AS (SELECT row_id, grp, min(v) AS lo, max(v) AS hi FROM g GROUP BY row_id, grp),
steps AS (
  SELECT *, greatest(0.0, least(15.0, 0.0 - round_even(xlo / s, 0)::DOUBLE)) AS z FROM (
    SELECT *, greatest(xhi - xlo, 1e-5) / 15.0 AS s FROM (
      SELECT r.*, i, (1 - i / 100.0::DOUBLE) * lo AS xlo, (1 - i / 100.0::DOUBLE) * hi AS xhi
      FROM r, (SELECT unnest(range(0, 80)) AS i)))
),
errs AS (
  SELECT row_id, grp, i, any_value(xlo) AS xlo, any_value(xhi) AS xhi, sum(power(abs(({_codes_sql()} - z) * s - v), 2.4)) AS err
  FROM g JOIN steps USING (row_id, grp) GROUP BY row_id, grp, i
)
SELECT row_id, grp, {rnd("arg_min(xlo, (err, i))")} AS low, {rnd("arg_min(xhi, (err, i))")} AS high, {rnd("min(err)")} AS err
FROM errs GROUP BY row_id, grp""",
)
def mse_range(spark, sf_dir):
    rows = Q.group_rows(X.weights(spark, sf_dir), "w", GROUP, ["row_id"])
    found = rows.withColumn("r", N.searched_range(F.col("v"), W4))
    return found.select(
        "row_id",
        F.col("group").cast("bigint").alias("grp"),
        r9("r.low").alias("low"),
        r9("r.high").alias("high"),
        r9("r.err").alias("err"),
    )


_BATCHED = "x AS (SELECT label AS input, row_id // 20 AS batch, v FROM w)"


def _activations(spark, sf_dir):
    return X.weights(spark, sf_dir).select(
        F.col("label").alias("input"), F.floor(F.col("row_id") / 20).cast("bigint").alias("batch"), F.col("w").alias("x")
    )


@query(
    "static_minmax",
    with_tables(WEIGHTS, _BATCHED)
    + f"""
SELECT input, {rnd("avg(lo)")} AS low, {rnd("avg(hi)")} AS high
FROM (SELECT input, batch, min(v) AS lo, max(v) AS hi FROM x GROUP BY input, batch) GROUP BY input""",
)
def static_minmax(spark, sf_dir):
    out = N.mean_range(_activations(spark, sf_dir), ["input"], "batch")
    return out.select("input", r9("low").alias("low"), r9("high").alias("high"))


@query(
    "moving_minmax",
    with_tables(WEIGHTS, _BATCHED)
    + f"""
SELECT input, {rnd("list_reduce(list(lo ORDER BY batch), lambda m, x: m + 0.01 * (x - m))")} AS low,
       {rnd("list_reduce(list(hi ORDER BY batch), lambda m, x: m + 0.01 * (x - m))")} AS high
FROM (SELECT input, batch, min(v) AS lo, max(v) AS hi FROM x GROUP BY input, batch) GROUP BY input""",
)
def moving_minmax(spark, sf_dir):
    out = N.moving_range(_activations(spark, sf_dir), ["input"], "batch", 0.01)
    return out.select("input", r9("low").alias("low"), r9("high").alias("high"))


@query("histogram_range")
def histogram_range(spark, sf_dir):
    out = N.histogram_range(_activations(spark, sf_dir), ["input"], "batch", 2**8)
    return out.select("input", *[r9(c).alias(c) for c in ("low", "high", "seen_low", "seen_high")])


@query(
    "seen_histogram",
    with_tables(WEIGHTS, _BATCHED)
    + f""",
b AS (SELECT input, batch, min(v) AS lo, max(v) AS hi FROM x GROUP BY input, batch),
seen AS (SELECT input, batch, min(lo) OVER o AS lo, max(hi) OVER o AS hi FROM b WINDOW o AS (PARTITION BY input ORDER BY batch))
SELECT input, {rnd("lo")} AS low, {rnd("hi")} AS high, bin, count(*) AS n
FROM (SELECT input, lo, hi, least(63, floor((v - lo) / (hi - lo) * 64))::INT AS bin FROM x JOIN seen USING (input, batch))
GROUP BY input, lo, hi, bin""",
)
def seen_histogram(spark, sf_dir):
    """The merged batch histograms before any range is widened, with 64 bins."""
    parts = N.batch_histograms(_activations(spark, sf_dir), ["input"], "batch", bins=64)
    return parts.select(
        "input", r9("low").alias("low"), r9("high").alias("high"), F.explode("counts").alias("bin", "n")
    )


_HIST = """
span AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
hist AS (SELECT input, least(31, floor((v - lo) / (hi - lo) * 32))::INT AS bin, count(*) AS n FROM x, span GROUP BY input, bin)"""


def _histogram(spark, sf_dir):
    rows = _activations(spark, sf_dir)
    span = rows.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"))
    values = Q.attach(rows, span).select("input", "lo", "hi", F.explode("x").alias("v"))
    return Q.value_histogram(values, F.col("v"), F.col("lo"), F.col("hi"), 32, ["input"])


@query("value_histogram", with_tables(WEIGHTS, _BATCHED, _HIST) + "SELECT input, bin, n FROM hist")
def value_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query(
    "histogram_quantile",
    with_tables(WEIGHTS, _BATCHED, _HIST)
    + """
SELECT input, min(bin) AS bin FROM (
  SELECT *, sum(n) OVER (PARTITION BY input ORDER BY bin) AS c, sum(n) OVER (PARTITION BY input) AS t FROM hist)
WHERE c >= t * 0.95 GROUP BY input""",
)
def histogram_quantile(spark, sf_dir):
    return N.quantile_bins(_histogram(spark, sf_dir), ["input"], 0.95)


@query("proximal_zeros")
def proximal_zeros(spark, sf_dir):
    rows = Q.quantise(X.weights(spark, sf_dir), W4, group=GROUP)
    out = N.proximal_zeros(rows, W4, ["row_id", "group"])
    return out.select("row_id", "group", r9("pitch").alias("pitch"), r9("zero", 6).alias("zero"), "steps")


# --- columns ---------------------------------------------------------------------------------

_COLUMNS = """
a AS (SELECT pos, max(abs(v)) AS a_max FROM w WHERE row_id % 2 = 0 GROUP BY pos),
wm AS (SELECT pos, greatest(max(abs(v)), 1e-5) AS w_max FROM w WHERE row_id % 2 = 1 GROUP BY pos)"""


@query(
    "smooth_pitch",
    with_tables(WEIGHTS, _COLUMNS)
    + f"""
SELECT pos, {rnd("a_max")} AS a_max, {rnd("w_max")} AS w_max,
       {rnd("greatest(power(a_max, 0.7) / power(w_max, 0.3), 1e-5)")} AS pitch
FROM a JOIN wm USING (pos)""",
)
def smooth_pitch(spark, sf_dir):
    """Even rows as activations, odd rows as weights."""
    rows = X.weights(spark, sf_dir)
    out = Q.smooth_pitch(rows.where("row_id % 2 = 0").withColumnRenamed("w", "x"), rows.where("row_id % 2 = 1"), 0.7)
    return out.select("pos", *[r9(c).alias(c) for c in ("a_max", "w_max", "pitch")])


@query(
    "outlier_columns",
    with_tables(WEIGHTS)
    + f"SELECT pos, {rnd('max(abs(v))')} AS a_max, max(abs(v)) >= 0.4 AS is_outlier FROM w GROUP BY pos",
)
def outlier_columns(spark, sf_dir):
    out = Q.outlier_columns(X.weights(spark, sf_dir), 0.4, "w")
    return out.withColumn("a_max", r9("a_max"))


@query(
    "top_outlier_columns",
    with_tables(WEIGHTS)
    + f"""
SELECT pos, {rnd("m")} AS a_max, row_number() OVER (ORDER BY m DESC, pos DESC) <= 8 AND max(m) OVER () > 0.3 AS is_outlier
FROM (SELECT pos, max(abs(v)) AS m FROM w GROUP BY pos)""",
)
def top_outlier_columns(spark, sf_dir):
    out = Q.top_outlier_columns(X.weights(spark, sf_dir), 8, 0.3, "w")
    return out.withColumn("a_max", r9("a_max"))


# --- layer output ----------------------------------------------------------------------------

_GRAM = """
h AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS h FROM w a JOIN w b USING (row_id) GROUP BY a.pos, b.pos)"""


def _both(spark, sf_dir):
    """The same rows as activations (x, with a batch) and as weights."""
    rows = X.weights(spark, sf_dir)
    x = rows.select(F.floor(F.col("row_id") / 20).cast("bigint").alias("batch"), F.col("w").alias("x"))
    return rows.select("row_id", "w"), x


@query("gram", with_tables(WEIGHTS, _GRAM) + f"SELECT i, j, {rnd('h')} AS h FROM h")
def gram(spark, sf_dir):
    _, x = _both(spark, sf_dir)
    return G.gram(x).select("i", F.posexplode("h").alias("j", "h")).withColumn("h", r9("h"))


_GRAM_BY_LABEL = """
h AS (SELECT a.label, a.pos AS i, b.pos AS j, sum(a.v * b.v) AS h FROM w a JOIN w b USING (row_id) GROUP BY a.label, a.pos, b.pos)"""


def _both_by_label(spark, sf_dir):
    """As ``_both``, with the label telling the matrices apart."""
    rows = X.weights(spark, sf_dir)
    batch = F.floor(F.col("row_id") / 20).cast("bigint").alias("batch")
    return rows.select("label", "row_id", "w"), rows.select("label", batch, F.col("w").alias("x"))


@query("gram_by_label", with_tables(WEIGHTS, _GRAM_BY_LABEL) + f"SELECT label, i, j, {rnd('h')} AS h FROM h")
def gram_by_label(spark, sf_dir):
    """A matrix per label from one pass."""
    _, x = _both_by_label(spark, sf_dir)
    return G.gram(x, keys=["label"]).select("label", "i", F.posexplode("h").alias("j", "h")).withColumn("h", r9("h"))


@query("error_feedback")
def error_feedback(spark, sf_dir):
    weights, x = _both(spark, sf_dir)
    factor = inverse_factors(G.pitched_hessian(x, "batch"), by_diagonal=True)
    out = G.error_feedback(weights, factor, W4, GROUP)
    return out.select("row_id", r9("loss", 6).alias("loss"), r9(total(F.col("snapped")), 6).alias("snapped_sum"))


@query("error_feedback_by_label")
def error_feedback_by_label(spark, sf_dir):
    """A matrix per label, all factored together in four tile rows each."""
    weights, x = _both_by_label(spark, sf_dir)
    factor = inverse_factors(G.pitched_hessian(x, "batch", keys=["label"]), by_diagonal=True, keys=["label"], tile=GROUP)
    out = G.error_feedback(weights, factor, W4, GROUP, keys=["label"])
    return out.select("label", "row_id", r9("loss", 6).alias("loss"), r9(total(F.col("snapped")), 6).alias("snapped_sum"))


_CANDIDATES = f"""
act AS (SELECT pos, avg(m) AS a FROM (SELECT row_id // 20 AS batch, pos, avg(abs(v)) AS m FROM w GROUP BY ALL) GROUP BY pos),
rel AS (SELECT pos, avg(abs(v) / top) AS wr FROM (SELECT *, max(abs(v)) OVER (PARTITION BY row_id, pos // 16) AS top FROM w) GROUP BY pos),
raw AS (SELECT pos, i AS step, greatest(power(a, i / 20.0) / power(wr, 1 - i / 20.0), 1e-4) AS s
        FROM act JOIN rel USING (pos), (SELECT unnest(range(0, 20))::INT AS i)),
cand AS (SELECT pos, step, s / sqrt(max(s) OVER g * min(s) OVER g) AS s FROM raw WINDOW g AS (PARTITION BY step))"""


@query(
    "pitch_candidates",
    with_tables(WEIGHTS, _CANDIDATES) + f"SELECT step, pos, {rnd('s')} AS s FROM cand",
)
def pitch_candidates(spark, sf_dir):
    weights, x = _both(spark, sf_dir)
    grid = [i / 20 for i in range(20)]
    out = G.pitch_candidates(G.activation_pitch(x, "batch"), G.weight_pitch(weights, GROUP), grid)
    return out.select("step", F.posexplode("s").alias("pos", "s")).withColumn("s", r9("s"))


@query(
    "best_pitch",
    with_tables(WEIGHTS, _CANDIDATES, _GRAM)
    + f""",
sc AS (SELECT row_id, step, pos, pos // 16 AS grp, w.v AS x, w.v * c.s AS v, c.s AS cs FROM w JOIN cand c USING (pos)),
"""
    + _params_sql("sc", "row_id, step, grp")
    + f""",
d AS (SELECT row_id, step, pos, ({_codes_sql()} - z) * s / cs - x AS d FROM sc JOIN p USING (row_id, step, grp)),
dd AS (SELECT step, a.pos AS i, b.pos AS j, sum(a.d * b.d) AS dd FROM d a JOIN d b USING (row_id, step) GROUP BY ALL),
losses AS (SELECT step, sum(dd * h) AS loss FROM dd JOIN h USING (i, j) GROUP BY step)
SELECT arg_min(step, (loss, step)) AS step, {rnd("min(loss)", 6)} AS loss FROM losses""",
)
def best_pitch(spark, sf_dir):
    weights, x = _both(spark, sf_dir)
    out = G.best_pitch(weights, x, "batch", W4, GROUP)
    return out.select("step", r9("loss", 6).alias("loss"))


@query(
    "best_pitch_by_label",
    with_tables(WEIGHTS, _GRAM_BY_LABEL)
    + f""",
act AS (SELECT label, pos, avg(m) AS a FROM (SELECT label, row_id // 20 AS batch, pos, avg(abs(v)) AS m FROM w GROUP BY ALL) GROUP BY label, pos),
rel AS (SELECT label, pos, avg(abs(v) / top) AS wr FROM (SELECT *, max(abs(v)) OVER (PARTITION BY row_id, pos // 16) AS top FROM w) GROUP BY label, pos),
raw AS (SELECT label, step::INT AS step, pos, greatest(power(a, step / 20.0::DOUBLE) / power(wr, 1 - step / 20.0::DOUBLE), 1e-4) AS s
        FROM act JOIN rel USING (label, pos), (SELECT unnest(range(0, 20)) AS step)),
cand AS (SELECT label, step, pos, s / sqrt(max(s) OVER (PARTITION BY label, step) * min(s) OVER (PARTITION BY label, step)) AS s FROM raw),
sc AS (SELECT label, row_id, step, pos, pos // 16 AS grp, w.v AS x, w.v * c.s AS v, c.s AS cs FROM w JOIN cand c USING (label, pos)),
"""
    + _params_sql("sc", "row_id, step, grp")
    + f""",
d AS (SELECT label, row_id, step, pos, ({_codes_sql()} - z) * s / cs - x AS d FROM sc JOIN p USING (row_id, step, grp)),
dd AS (SELECT a.label, step, a.pos AS i, b.pos AS j, sum(a.d * b.d) AS dd FROM d a JOIN d b USING (row_id, step) GROUP BY ALL),
losses AS (SELECT label, step, sum(dd * h) AS loss FROM dd JOIN h USING (label, i, j) GROUP BY label, step)
SELECT label, arg_min(step, (loss, step)) AS step, {rnd("min(loss)", 6)} AS loss FROM losses GROUP BY label""",
)
def best_pitch_by_label(spark, sf_dir):
    """The search for ten matrices at once."""
    weights, x = _both_by_label(spark, sf_dir)
    out = G.best_pitch(weights, x, "batch", W4, GROUP, keys=["label"])
    return out.select("label", "step", r9("loss", 6).alias("loss"))


@query(
    "clip_search",
    with_tables(WEIGHTS, _GRAM)
    + f""",
top AS (SELECT row_id, pos // 16 AS grp, max(abs(v)) AS m FROM w GROUP BY ALL),
cl AS (SELECT w.row_id, w.pos // 16 AS grp, pos, i AS step, w.v AS x, m * (1 - i / 20.0::DOUBLE) AS hi,
         greatest(-m * (1 - i / 20.0::DOUBLE), least(m * (1 - i / 20.0::DOUBLE), w.v)) AS v
       FROM w JOIN top ON top.row_id = w.row_id AND top.grp = w.pos // 16, (SELECT unnest(range(0, 10))::INT AS i)),
"""
    + _params_sql("cl", "row_id, step, grp")
    + f""",
d AS (SELECT row_id, step, grp, pos, hi, ({_codes_sql()} - z) * s - x AS d FROM cl JOIN p USING (row_id, step, grp)),
l AS (SELECT a.row_id, a.grp, a.step, any_value(a.hi) AS hi, sum(a.d * b.d * h.h) / (SELECT count(DISTINCT row_id) FROM w) AS loss
      FROM d a JOIN d b USING (row_id, step, grp) JOIN h ON h.i = a.pos AND h.j = b.pos GROUP BY a.row_id, a.grp, a.step)
SELECT row_id, grp, arg_min(step, (loss, step)) AS step, {rnd("arg_min(hi, (loss, step))")} AS high, {rnd("min(loss)")} AS loss
FROM l GROUP BY row_id, grp""",
)
def clip_search(spark, sf_dir):
    weights, x = _both(spark, sf_dir)
    n_rows = F.col("n")
    # The mean over activation rows is taken by scaling the Gram matrix, so nothing is counted ahead.
    counted = Q.attach(G.gram(x), x.agg(F.count(F.lit(1)).alias("n")))
    h = counted.select("i", F.transform("h", lambda v: v / n_rows).alias("h"))
    out = G.clip_search(weights, h, W4, GROUP, 1)
    return out.select(
        "row_id", F.col("group").cast("bigint").alias("grp"), "step", r9("high").alias("high"), r9("loss").alias("loss")
    )


@query(
    "better_direction",
    with_tables(WEIGHTS, _GRAM)
    + ","
    + _params_sql("w", "row_id").replace("p AS", "po AS", 1)
    + ","
    + _params_sql("w", "pos").replace("p AS", "pi AS", 1)
    + f""",
d AS (
  SELECT 'oc' AS direction, row_id, pos, ({_codes_sql()} - z) * s - v AS d FROM w JOIN po USING (row_id)
  UNION ALL SELECT 'ic', row_id, pos, ({_codes_sql()} - z) * s - v FROM w JOIN pi USING (pos)
),
dd AS (SELECT direction, a.pos AS i, b.pos AS j, sum(a.d * b.d) AS dd FROM d a JOIN d b USING (direction, row_id) GROUP BY ALL),
l AS (SELECT direction, sum(dd * h) AS loss FROM dd JOIN h USING (i, j) GROUP BY direction)
SELECT {rnd("max(loss) FILTER (direction = 'oc')", 6)} AS oc_loss, {rnd("max(loss) FILTER (direction = 'ic')", 6)} AS ic_loss,
       arg_min(direction, loss) AS direction FROM l""",
)
def better_direction(spark, sf_dir):
    weights, x = _both(spark, sf_dir)
    out = G.better_direction(weights, x, W4)
    return out.select(r9("oc_loss", 6).alias("oc_loss"), r9("ic_loss", 6).alias("ic_loss"), "direction")


@query(
    "layers_left_out",
    with_tables(WEIGHTS, _GROUPED)
    + ","
    + _params_sql("g", "row_id, grp")
    + f""",
c AS (SELECT row_id, label, v, (({_codes_sql()}) - z) * s AS q FROM g JOIN p USING (row_id, grp))
SELECT row_id, {rnd("sum(CASE WHEN label BETWEEN 0 AND 4 OR label = 7 OR label = 9 THEN v ELSE q END)")} AS row_sum FROM c GROUP BY row_id""",
)
def layers_left_out(spark, sf_dir):
    """Rounding to nearest with a range of blocks, a block and a layer by name left as they are."""
    rows = X.weights(spark, sf_dir).withColumn("block", F.col("label"))
    rows = rows.withColumn("layer", F.when(F.col("label") == 9, "head").otherwise("inner"))
    out = M.quantise_weights("rtn_w4", rows, rows.select(F.col("w").alias("x")), GROUP, left_out=["0-4", "7", "head"])
    return out.select("row_id", r9(total(F.col("w"))).alias("row_sum"))


@query("compared_methods")
def compared_methods(spark, sf_dir):
    """Every registered method at four bits: mean and largest error of its weights."""
    weights, x = _both(spark, sf_dir)
    out = None
    for name in sorted(M.METHODS):
        changed = M.quantise_weights(f"{name}_w4", weights, x, GROUP).withColumnRenamed("w", "q")
        gap = F.zip_with("w", "q", lambda a, b: F.abs(a - b))
        errors = weights.join(changed, "row_id").select(
            Q.row_error(F.col("w"), F.col("q")).alias("mse"), F.array_max(gap).alias("worst")
        )
        part = errors.agg(F.avg("mse").alias("mse"), F.max("worst").alias("worst"), F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(f"{name}_w4").alias("method_id"), r9("mse").alias("mse"), r9("worst").alias("worst"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- pruning and analysis --------------------------------------------------------------------

@query(
    "magnitude_prune",
    with_tables(WEIGHTS)
    + f""",
cut AS (SELECT list(abs(v) ORDER BY abs(v))[floor(count(*) * 0.3)::BIGINT + 1] AS t FROM w)
SELECT row_id, count_if(abs(v) <= t)::INT AS pruned, {rnd("sum(CASE WHEN abs(v) <= t THEN 0 ELSE v END)")} AS row_sum
FROM w, cut GROUP BY row_id""",
)
def magnitude_prune(spark, sf_dir):
    out = U.magnitude_prune(X.weights(spark, sf_dir), 0.3)
    return out.select("row_id", "pruned", r9(total(F.col("w"))).alias("row_sum"))


@query(
    "activation_prune",
    with_tables(WEIGHTS)
    + f""",
pw AS (SELECT pos, sum(v * v) / (SELECT count(DISTINCT row_id // 20) FROM w) AS power FROM w GROUP BY pos),
m AS (SELECT w.*, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) * sqrt(power), pos) AS rn FROM w JOIN pw USING (pos))
SELECT row_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (rn <= 25) AS dropped,
       {rnd("sum(v) FILTER (rn > 25)")} AS row_sum FROM m GROUP BY row_id""",
)
def activation_prune(spark, sf_dir):
    """A row of 64 at a share of 0.4 loses 25."""
    weights, x = _both(spark, sf_dir)
    out = U.activation_prune(weights, x, 0.4, F.count_distinct("batch"))
    return out.select(
        "row_id",
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"),
        r9(total(F.col("w"))).alias("row_sum"),
    )


_IMPORTANCE = """
pairs AS (
  SELECT label AS layer, row_id, sum(a.v * b.v) AS dot, sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)) AS len
  FROM w a JOIN (SELECT row_id, 63 - pos AS pos, v FROM w) b USING (row_id, pos) GROUP BY label, row_id
),
imp AS (SELECT layer, sum(1 - CASE WHEN len = 0 THEN 0.5 ELSE dot / len END) AS importance FROM pairs GROUP BY layer)"""


def _importance(spark, sf_dir):
    rows = X.weights(spark, sf_dir).select(F.col("label").alias("layer"), F.col("row_id").alias("token"), F.col("w").alias("x"))
    return rows, U.layer_importance(rows, rows.withColumn("x", F.reverse("x")), "layer", "token")


@query(
    "block_importance",
    with_tables(WEIGHTS, _IMPORTANCE) + f"SELECT layer, {rnd('importance')} AS importance FROM imp",
)
def block_importance(spark, sf_dir):
    """A layer's output is its input in reverse."""
    return _importance(spark, sf_dir)[1].withColumn("importance", r9("importance"))


@query(
    "drop_layers",
    with_tables(WEIGHTS, _IMPORTANCE)
    + """
SELECT label AS layer, count(DISTINCT row_id) AS n FROM w
WHERE label NOT IN (SELECT layer FROM imp ORDER BY importance, layer LIMIT 3) GROUP BY label""",
)
def drop_layers(spark, sf_dir):
    rows, importance = _importance(spark, sf_dir)
    return U.without_layers(rows, importance, 3, "layer").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kurtosis_rows",
    with_tables(WEIGHTS)
    + f""",
m AS (SELECT row_id, avg(v) AS mu, stddev_samp(v) AS sd FROM w GROUP BY row_id)
SELECT row_id, {rnd("avg(power((v - mu) / sd, 4))")} AS kurtosis FROM w JOIN m USING (row_id) GROUP BY row_id""",
)
def kurtosis_rows(spark, sf_dir):
    return U.kurtosis_rows(X.weights(spark, sf_dir)).withColumn("kurtosis", r9("kurtosis"))


@query(
    "kurtosis_mean",
    with_tables(WEIGHTS)
    + f""",
m AS (SELECT row_id, label, avg(v) AS mu, stddev_samp(v) AS sd FROM w GROUP BY row_id, label),
k AS (SELECT m.label, row_id, avg(power((v - mu) / sd, 4)) AS k FROM w JOIN m USING (row_id) GROUP BY m.label, row_id)
SELECT label, {rnd("avg(k)")} AS kurtosis FROM k GROUP BY label""",
)
def kurtosis_mean(spark, sf_dir):
    rows = U.kurtosis_rows(X.weights(spark, sf_dir), keep=["label", "row_id"])
    return rows.groupBy("label").agg(r9(F.avg("kurtosis")).alias("kurtosis"))


@query(
    "cosine_by_label",
    with_tables(WEIGHTS, _GROUPED)
    + ","
    + _params_sql("g", "row_id, grp")
    + f""",
c AS (SELECT g.*, ({_codes_sql()} - z) * s AS y FROM g JOIN p USING (row_id, grp)),
cs AS (SELECT label, row_id, sum(v * y) / (sqrt(sum(v * v)) * sqrt(sum(y * y))) AS cos FROM c GROUP BY label, row_id)
SELECT label, {rnd("min(cos)")} AS min_cos, {rnd("avg(cos)")} AS avg_cos, count(*) AS n FROM cs GROUP BY label""",
)
def cosine_by_label(spark, sf_dir):
    """Full-precision rows against their quantised copies."""
    rows = X.weights(spark, sf_dir)
    out = U.cosine_summary(Q.round_rows(rows, W4, group=GROUP), "label", "w", "snapped")
    return out.select("label", r9("min_cos").alias("min_cos"), r9("avg_cos").alias("avg_cos"), "n")


@query(
    "batch_loss",
    with_tables(WEIGHTS, _GROUPED)
    + ","
    + _params_sql("g", "row_id, grp")
    + f""",
c AS (SELECT g.row_id // 20 AS batch, v, ({_codes_sql()} - z) * s AS y FROM g JOIN p USING (row_id, grp)),
b AS (SELECT batch, avg((v - y) * (v - y)) AS loss FROM c GROUP BY batch)
SELECT {rnd("avg(loss)")} AS loss, count(*) AS n_batches FROM b""",
)
def batch_loss(spark, sf_dir):
    rows = X.weights(spark, sf_dir).withColumn("batch", F.floor(F.col("row_id") / 20).cast("bigint"))
    out = U.batch_loss(Q.round_rows(rows, W4, group=GROUP), "batch", "w", "snapped")
    return out.withColumn("loss", r9("loss"))


# --- evaluation ------------------------------------------------------------------------------

_TOKENS = """
tok AS (SELECT row_id, label, pos // 4 AS layer, pos % 4 AS k, 10 * v AS l, round_even(40 * v, 0)::DOUBLE / 4 AS lq FROM w),
nll AS (SELECT row_id, label, layer, ln(sum(exp(l))) - max(l) FILTER (k = label % 4) AS nll,
          arg_min(k, (-l, k)) AS best, arg_min(k, (-lq, k)) AS best_q FROM tok GROUP BY row_id, label, layer)"""


def _tokens(spark, sf_dir, quantised=False):
    rows = X.layer_table(spark, sf_dir, "plain", quantised)
    return rows.select("question_id", "correct_answer_index", F.inline("layers"))


@query(
    "perplexity",
    with_tables(WEIGHTS, _TOKENS)
    + f"SELECT layer, {rnd('exp(sum(nll) / count(*))')} AS perplexity, count(*) AS n_tokens FROM nll GROUP BY layer",
)
def perplexity(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    target = F.ascii("correct_answer_index") - 65
    scored = tokens.withColumn("nll", E.negative_log_likelihood(F.col("logits"), target))
    out = E.perplexity(scored, ["layer"])
    return out.select(F.col("layer").cast("bigint").alias("layer"), r9("perplexity").alias("perplexity"), "n_tokens")


@query(
    "token_consistency",
    with_tables(WEIGHTS, _TOKENS)
    + f"SELECT layer, {rnd('avg((best = best_q)::INT)')} AS consistency, count(*) AS n FROM nll GROUP BY layer",
)
def token_consistency(spark, sf_dir):
    out = E.token_consistency(_tokens(spark, sf_dir), _tokens(spark, sf_dir, True), ["question_id", "layer"], ["layer"])
    return out.select(F.col("layer").cast("bigint").alias("layer"), r9("consistency").alias("consistency"), "n")


@query(
    "top1_accuracy",
    with_tables(WEIGHTS, _TOKENS)
    + f"SELECT layer, {rnd('100 * avg((best = label % 4)::INT)')} AS accuracy, count(*) AS n FROM nll GROUP BY layer",
)
def top1_accuracy(spark, sf_dir):
    out = E.top1_accuracy(_tokens(spark, sf_dir), "logits", F.ascii("correct_answer_index") - 65, ["layer"])
    return out.select(F.col("layer").cast("bigint").alias("layer"), r9("accuracy").alias("accuracy"), "n")
