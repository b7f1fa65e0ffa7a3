"""Registered queries over per-layer logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions import prob as P
from tiltmeter.functions.text import letter_at
from tiltmeter.operators import layers as L
from tiltmeter.operators import stats as S
from tiltmeter.operators import trajectories as T
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.sql import LAYERS, letter, rnd, with_tables

# Spans and softmax per question and layer; softmax keeps the engine's guard against division by zero.
_SPANS = """
spans AS (
  SELECT *, min(plain) OVER g AS plain_low, max(plain) OVER g AS plain_high,
         min(opinion) OVER g AS opinion_low, max(opinion) OVER g AS opinion_high
  FROM layers WINDOW g AS (PARTITION BY question_id, layer)
)"""

_SCORES = """
scores AS (
  SELECT *, (plain - plain_low) / (plain_high - plain_low + 1e-9) AS plain_score,
         (opinion - opinion_low) / (opinion_high - opinion_low + 1e-9) AS opinion_score
  FROM spans
)"""


def _softmax_sql(source: str, columns: list[str], eps: str = "1e-10") -> str:
    shares = ", ".join(
        f"exp({c} - max({c}) OVER g) AS {c}_e" for c in columns
    )
    return f"""
{source}_exp AS (SELECT *, {shares} FROM {source} WINDOW g AS (PARTITION BY question_id, layer)),
{source}_p AS (
  SELECT *, {", ".join(f"{c}_e / (sum({c}_e) OVER g + {eps}) AS {c}_p" for c in columns)}
  FROM {source}_exp WINDOW g AS (PARTITION BY question_id, layer)
)"""


def _kl_sql(p: str, q: str) -> str:
    return f"({p} + 1e-10) * (ln({p} + 1e-10) - ln({q} + 1e-10))"


@query(
    "decision_score_correct",
    with_tables(LAYERS, _SPANS, _SCORES)
    + f"""
SELECT layer, {rnd("avg(plain_score)")} AS plain, {rnd("avg(opinion_score)")} AS opinion, count(*) AS n
FROM scores WHERE pos = right_pos GROUP BY layer""",
)
def decision_score_correct(spark, sf_dir):
    """Score of the right letter under both prompts, joined layer by layer once they are curves."""
    letters = {"score": "correct_answer_index"}
    plain = L.score_curve(L.decision_scores(X.layer_table(spark, sf_dir, "plain"), letters), ["score"])
    opinion = L.score_curve(L.decision_scores(X.layer_table(spark, sf_dir, "opinion"), letters), ["score"])
    return (
        plain.select("layer", r9("score").alias("plain"), "n")
        .join(opinion.select("layer", r9("score").alias("opinion")), "layer")
        .select("layer", "plain", "opinion", "n")
    )


@query(
    "decision_score_wrong",
    with_tables(LAYERS, _SPANS, _SCORES)
    + f"""
SELECT layer, {rnd("avg(plain_score)")} AS plain, {rnd("avg(opinion_score)")} AS opinion, count(*) AS n
FROM scores WHERE pos = wrong_pos GROUP BY layer""",
)
def decision_score_wrong(spark, sf_dir):
    """Score of the suggested letter; plain rows take the letter from the opinion run."""
    opinion = X.layer_table(spark, sf_dir, "opinion")
    plain = L.with_suggested_letter(X.layer_table(spark, sf_dir, "plain"), opinion)
    on_plain = L.score_curve(L.decision_scores(plain, {"score": "suggested"}), ["score"])
    on_opinion = L.score_curve(L.decision_scores(opinion, {"score": "chosen_wrong_answer_index"}), ["score"])
    return (
        on_plain.select("layer", r9("score").alias("plain"), "n")
        .join(on_opinion.select("layer", r9("score").alias("opinion")), "layer")
        .select("layer", "plain", "opinion", "n")
    )


def _own_letter_sql(position: str) -> str:
    return with_tables(LAYERS, _SPANS, _SCORES) + f"""
SELECT layer, {rnd("avg(plain_score)")} AS plain, count(*) AS n FROM scores WHERE {position} GROUP BY layer"""


def _own_letter(spark, sf_dir, own):
    plain = X.layer_table(spark, sf_dir, "plain").withColumn("chosen_wrong_answer_index", own)
    marked = L.with_suggested_letter(plain, X.layer_table(spark, sf_dir, "opinion"))
    scores = L.decision_scores(marked, {"score": "suggested"}).where(F.col("score").isNotNull())
    return L.score_curve(scores, ["score"]).select("layer", r9("score").alias("plain"), "n")


@query("decision_score_empty_own", _own_letter_sql("pos = wrong_pos"))
def decision_score_empty_own(spark, sf_dir):
    """A column of their own without any value: plain rows take the letter from the opinion run."""
    return _own_letter(spark, sf_dir, F.lit(None).cast("string"))


@query("decision_score_own", _own_letter_sql("pos = right_pos AND question_id % 2 = 0"))
def decision_score_own(spark, sf_dir):
    """A column of their own with some values: it alone counts."""
    return _own_letter(spark, sf_dir, F.when(F.col("question_id") % 2 == 0, F.col("correct_answer_index")))


def _seeded(df, opinion: bool):
    """Three seeds of a run; every seed suggests its own wrong letter."""
    out = df.withColumn("data_seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in X.SEEDS])))
    if opinion:
        right = F.ascii("correct_answer_index") - 65
        wrong = ((right + 1 + (F.col("question_id") + F.col("data_seed")) % 3) % 4).cast("int")
        out = out.withColumn("chosen_wrong_answer_index", letter_at(wrong))
    return out


_SEEDED = """
seeded AS (
  SELECT s.*, d.data_seed, (right_pos + 1 + (question_id + d.data_seed) % 3) % 4 AS seed_pos,
         (right_pos + 1 + (question_id + 1) % 3) % 4 AS first_pos
  FROM scores s, (SELECT unnest([1, 2, 3])::BIGINT AS data_seed) d
)"""


@query(
    "decision_score_wrong_seeds",
    with_tables(LAYERS, _SPANS, _SCORES, _SEEDED)
    + f"""
SELECT data_seed, layer, {rnd("avg(plain_score)")} AS score, count(*) AS n
FROM seeded WHERE pos = seed_pos GROUP BY data_seed, layer""",
)
def decision_score_wrong_seeds(spark, sf_dir):
    """Plain rows take the letter their own seed suggested."""
    opinion = _seeded(X.layer_table(spark, sf_dir, "opinion").drop("layers"), True)
    plain = _seeded(X.layer_table(spark, sf_dir, "plain"), False)
    marked = L.with_suggested_letter(plain, opinion, ["question_id", "data_seed"])
    scores = L.decision_scores(marked, {"score": "suggested"}, ["data_seed"])
    return L.score_curve(scores, ["score"], ["data_seed"]).withColumn("score", r9("score"))


@query(
    "decision_score_first_seed",
    with_tables(LAYERS, _SPANS, _SCORES, _SEEDED)
    + f"""
SELECT data_seed, layer, {rnd("avg(plain_score)")} AS score, count(*) AS n
FROM seeded WHERE pos = first_pos GROUP BY data_seed, layer""",
)
def decision_score_first_seed(spark, sf_dir):
    """The older rule: the first seed's letters serve every plain run."""
    opinion = _seeded(X.layer_table(spark, sf_dir, "opinion").drop("layers"), True).where("data_seed = 1")
    plain = _seeded(X.layer_table(spark, sf_dir, "plain"), False)
    marked = L.with_suggested_letter(plain, opinion, ["question_id"])
    scores = L.decision_scores(marked, {"score": "suggested"}, ["data_seed"])
    return L.score_curve(scores, ["score"], ["data_seed"]).withColumn("score", r9("score"))


_LEVEL_POS = "(right_pos + 1 + (question_id + CASE level WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 ELSE 2 END) % 3) % 4"


@query(
    "decision_score_levels",
    with_tables(LAYERS, _SPANS, _SCORES)
    + f"""
SELECT level, layer, {rnd("avg(opinion_score)")} AS score, count(*) AS n
FROM scores, (SELECT unnest(['beginner', 'intermediate', 'advanced']) AS level)
WHERE pos = {_LEVEL_POS} GROUP BY level, layer""",
)
def decision_score_levels(spark, sf_dir):
    """Score of the suggested letter by level of expertise; every level suggests its own letter."""
    runs = X.layer_table(spark, sf_dir, "opinion").withColumn("level", F.explode(X.literals(X.LEVELS)))
    shift = F.when(F.col("level") == "beginner", 0).when(F.col("level") == "intermediate", 1).otherwise(2)
    right = F.ascii("correct_answer_index") - 65
    runs = runs.withColumn(
        "chosen_wrong_answer_index", letter_at(((right + 1 + (F.col("question_id") + shift) % 3) % 4).cast("int"))
    )
    scores = L.decision_scores(runs, {"score": "chosen_wrong_answer_index"}, ["level"])
    return L.score_curve(scores, ["score"], ["level"]).withColumn("score", r9("score"))


@query(
    "decision_score_precisions",
    with_tables(LAYERS, _SPANS)
    + f""",
low AS (
  SELECT *, min(opinion) OVER g AS lo, max(opinion) OVER g AS hi
  FROM quantised WINDOW g AS (PARTITION BY question_id, layer)
)
SELECT 'full_precision' AS precision, layer,
       {rnd("avg((opinion - opinion_low) / (opinion_high - opinion_low + 1e-9))")} AS score, count(*) AS n
FROM spans WHERE pos = wrong_pos GROUP BY layer
UNION ALL
SELECT 'quantised', layer, {rnd("avg((opinion - lo) / (hi - lo + 1e-9))")}, count(*) FROM low
WHERE pos = wrong_pos GROUP BY layer""",
)
def decision_score_precisions(spark, sf_dir):
    full = X.layer_table(spark, sf_dir, "opinion").withColumn("precision", F.lit("full_precision"))
    low = X.layer_table(spark, sf_dir, "opinion", quantised=True).withColumn("precision", F.lit("quantised"))
    scores = L.decision_scores(full.unionByName(low), {"score": "chosen_wrong_answer_index"}, ["precision"])
    return L.score_curve(scores, ["score"], ["precision"]).withColumn("score", r9("score"))


@query(
    "kl_opinion_plain",
    with_tables(LAYERS, _softmax_sql("layers", ["plain", "opinion"]))
    + f"""
SELECT layer, {rnd("avg(kl)")} AS kl, count(*) AS n
FROM (SELECT question_id, layer, sum({_kl_sql("opinion_p", "plain_p")}) AS kl FROM layers_p GROUP BY ALL) GROUP BY layer""",
)
def kl_opinion_plain(spark, sf_dir):
    pairs = L.pair_runs(X.layer_table(spark, sf_dir, "opinion"), X.layer_table(spark, sf_dir, "plain"))
    return L.kl_curve(pairs).withColumn("kl", r9("kl"))


@query(
    "kl_quant_fp",
    with_tables(
        LAYERS,
        "both_runs AS (SELECT l.question_id, l.layer, l.pos, l.opinion AS fp, q.opinion AS qn FROM layers l"
        " JOIN quantised q USING (question_id, layer, pos))",
        _softmax_sql("both_runs", ["fp", "qn"]),
    )
    + f""",
per_question AS (
  SELECT d.data_seed, question_id, layer, sum({_kl_sql("qn_p", "fp_p")}) AS kl
  FROM both_runs_p, (SELECT unnest([1, 2, 3])::BIGINT AS data_seed) d
  WHERE (question_id + data_seed) % 4 <> 0 GROUP BY ALL
),
per_seed AS (SELECT data_seed, layer, avg(kl) AS kl FROM per_question GROUP BY ALL)
SELECT layer, {rnd("avg(kl)")} AS kl, count(*) AS n_seeds FROM per_seed GROUP BY layer""",
)
def kl_quant_fp(spark, sf_dir):
    """Each seed asks its own three quarters of the questions; curves are averaged over seeds."""
    kept = (F.col("question_id") + F.col("data_seed")) % 4 != 0
    full = _seeded(X.layer_table(spark, sf_dir, "opinion"), True).where(kept)
    low = _seeded(X.layer_table(spark, sf_dir, "opinion", quantised=True), True).where(kept)
    curves = L.kl_curve(L.pair_runs(low, full, ["question_id", "data_seed"]), ["data_seed"])
    return L.mean_over_seeds(curves, "kl").withColumn("kl", r9("kl"))


@query(
    "kl_from_maps",
    with_tables(LAYERS, _softmax_sql("layers", ["plain", "opinion"]))
    + f"""
SELECT layer, {rnd("avg(kl)")} AS kl, count(*) AS n
FROM (SELECT question_id, layer, sum({_kl_sql("opinion_p", "plain_p")}) AS kl FROM layers_p
      WHERE NOT (question_id % 13 = 0 AND layer = 5) AND NOT (question_id % 11 = 0 AND layer = 3)
        AND layer BETWEEN 2 AND 12 GROUP BY ALL)
GROUP BY layer""",
)
def kl_from_maps(spark, sf_dir):
    """From raw nested maps with unreadable layer names and missing letters, layers 2 to 12."""
    opinion = L.in_range(L.layers_from_maps(X.raw_layer_maps(spark, sf_dir, "opinion")), 2, 12)
    plain = L.in_range(L.layers_from_maps(X.raw_layer_maps(spark, sf_dir, "plain")), 2, 12)
    return L.kl_curve(L.pair_runs(opinion, plain)).withColumn("kl", r9("kl"))


@query(
    "kl_all_rows",
    with_tables(LAYERS, _softmax_sql("layers", ["plain", "opinion"]))
    + f"""
SELECT layer, {rnd("avg(kl)")} AS kl, count(*) AS n
FROM (SELECT question_id, layer, sum({_kl_sql("opinion_p", "plain_p")}) AS kl FROM layers_p
      GROUP BY ALL) GROUP BY layer""",
)
def kl_all_rows(spark, sf_dir):
    """The curve of all rows, opinion against plain; there is no row cap."""
    opinion, plain = X.layer_table(spark, sf_dir, "opinion"), X.layer_table(spark, sf_dir, "plain")
    return L.kl_curve(L.pair_runs(opinion, plain)).withColumn("kl", r9("kl"))


@query(
    "layer_subsets",
    with_tables(LAYERS)
    + """
SELECT which, layer, count(DISTINCT question_id) AS n
FROM layers, (SELECT unnest(['all', 'odd', 'even', 'last']) AS which)
WHERE which = 'all' OR layer = 15 OR (which = 'odd' AND layer % 2 = 1) OR (which = 'even' AND layer % 2 = 0)
GROUP BY which, layer""",
)
def layer_subsets(spark, sf_dir):
    """All four choices from one scan."""
    choices = [F.struct(F.lit(w).alias("which"), L.chosen_layers(w).alias("layers")) for w in ("all", "odd", "even", "last")]
    runs = X.layer_table(spark, sf_dir, "plain").select(F.inline(F.array(*choices)))
    return runs.select("which", F.explode("layers.layer").alias("layer")).groupBy("which", "layer").agg(F.count(F.lit(1)).alias("n"))


# --- alignment -------------------------------------------------------------------------------

_ALIGN_RUNS = """
runs AS (
  SELECT o_orderkey AS row_idx, 'q' || (o_orderkey // 2) AS synthetic_id, o_orderstatus AS model_answer FROM orders
),
plain_run AS (SELECT * FROM runs WHERE row_idx % 2 = 0),
opinion_run AS (SELECT * FROM runs WHERE row_idx % 2 = 1)"""


def _align_runs(spark, sf_dir):
    runs = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        F.concat(F.lit("q"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("synthetic_id"),
        F.col("o_orderstatus").alias("model_answer"),
    )
    return runs.where("row_idx % 2 = 0"), runs.where("row_idx % 2 = 1")


@query(
    "align_by_key",
    with_tables(_ALIGN_RUNS)
    + """
SELECT p.synthetic_id, p.row_idx AS row_idx_plain, p.model_answer AS model_answer_plain,
       o.row_idx AS row_idx_opinion, o.model_answer AS model_answer_opinion,
       row_number() OVER (ORDER BY p.row_idx, o.row_idx) - 1 AS uid
FROM plain_run p JOIN opinion_run o USING (synthetic_id)""",
)
def align_by_key(spark, sf_dir):
    plain, opinion = _align_runs(spark, sf_dir)
    return L.align(plain, opinion, "synthetic_id", "row_idx")


@query(
    "misaligned_pairs",
    """
SELECT p_partkey AS question_id, p_name AS "left", p_brand AS "right" FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT p_partkey, p_name, NULL FROM part WHERE p_partkey % 10 = 1""",
)
def misaligned_pairs(spark, sf_dir):
    """Two runs of the same questions, one of which has other or missing texts at some places."""
    rows = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("q"), "p_brand")
    place = F.col("question_id") % 10
    other = rows.withColumn("q", F.when(place == 0, F.col("p_brand")).when(place != 1, F.col("q")))
    return L.misaligned_pairs(rows, other, ["question_id"], "q")


@query(
    "align_first_per_key",
    with_tables(_ALIGN_RUNS)
    + """,
p AS (SELECT * FROM plain_run QUALIFY row_number() OVER (PARTITION BY synthetic_id ORDER BY row_idx) = 1),
o AS (SELECT * FROM opinion_run QUALIFY row_number() OVER (PARTITION BY synthetic_id ORDER BY row_idx) = 1)
SELECT p.synthetic_id, p.row_idx AS row_idx_plain, p.model_answer AS model_answer_plain,
       o.row_idx AS row_idx_opinion, o.model_answer AS model_answer_opinion,
       row_number() OVER (ORDER BY p.row_idx, o.row_idx) - 1 AS uid
FROM p JOIN o USING (synthetic_id)""",
)
def align_first_per_key(spark, sf_dir):
    plain, opinion = _align_runs(spark, sf_dir)
    return L.align(
        L.first_per_key(plain, "synthetic_id", "row_idx"),
        L.first_per_key(opinion, "synthetic_id", "row_idx"),
        "synthetic_id",
        "row_idx",
    )


# --- trajectories ----------------------------------------------------------------------------

_PATHS = """
long AS (
  SELECT question_id, right_pos, wrong_pos, layer, pos, 'plain' AS condition, plain AS v FROM layers
  UNION ALL SELECT question_id, right_pos, wrong_pos, layer, pos, 'opinion', opinion FROM layers
),
steps AS (
  SELECT question_id, condition, layer, any_value(right_pos) AS right_pos, any_value(wrong_pos) AS wrong_pos,
         arg_min(pos, (-v, pos)) AS pred, 1 / sum(exp(v - top)) AS conf
  FROM (SELECT *, max(v) OVER (PARTITION BY question_id, condition, layer) AS top FROM long)
  GROUP BY question_id, condition, layer
),
framed AS (
  SELECT *, lag(pred) OVER g AS before, lead(pred) OVER g AS next1, lead(pred, 2) OVER g AS next2,
         last_value(pred) OVER (PARTITION BY question_id, condition ORDER BY layer
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM steps WINDOW g AS (PARTITION BY question_id, condition ORDER BY layer)
),
paths AS (
  SELECT question_id, condition, any_value(right_pos) AS right_pos, any_value(wrong_pos) AS wrong_pos,
         any_value(final) AS final, count_if(pred <> before)::INT AS changes,
         min(layer) FILTER (pred = final AND next1 = final AND next2 = final) AS stable,
         arg_max(conf, layer) AS final_conf
  FROM framed GROUP BY question_id, condition
)"""


def _paths(spark, sf_dir, condition):
    """Every question knows the suggested letter, also on the plain prompt."""
    runs = X.layer_table(spark, sf_dir, condition)
    return T.trajectories(runs)


@query(
    "trajectory_stats",
    with_tables(LAYERS, _PATHS)
    + f"""
SELECT question_id, condition, {letter("final")} AS final_prediction, changes AS prediction_changes,
       stable AS stabilisation_layer, {rnd("final_conf")} AS final_confidence, final = right_pos AS is_correct
FROM paths""",
)
def trajectory_stats(spark, sf_dir):
    parts = [
        _paths(spark, sf_dir, c).select(
            "question_id",
            F.lit(c).alias("condition"),
            "final_prediction",
            "prediction_changes",
            "stabilisation_layer",
            r9("final_confidence").alias("final_confidence"),
            "is_correct",
        )
        for c in ("plain", "opinion")
    ]
    return parts[0].unionByName(parts[1])


_EMERGENCE = """
emerged AS (
  SELECT question_id, any_value(final) = any_value(wrong_pos) AS follows_opinion,
         min(layer) FILTER (pred = wrong_pos) AS first_opinion_match,
         arg_min(conf, layer) FILTER (pred = wrong_pos) AS confidence_at_match,
         min(layer) FILTER (pred = wrong_pos AND next1 = wrong_pos AND next2 = wrong_pos) AS first_opinion_stable,
         min(layer) FILTER (pred = wrong_pos AND next1 = wrong_pos) AS first_opinion_pair,
         min(layer) FILTER (pred = right_pos AND right_pos <> wrong_pos) AS first_correct_match,
         avg((pred = wrong_pos)::INT) AS opinion_dominance,
         avg(conf) FILTER (pred = wrong_pos) AS opinion_confidence,
         avg(conf) FILTER (pred = right_pos) AS correct_confidence
  FROM framed WHERE condition = 'opinion' GROUP BY question_id
)"""


@query(
    "emergence",
    with_tables(LAYERS, _PATHS, _EMERGENCE)
    + f"""
SELECT question_id, follows_opinion, first_opinion_match, {rnd("confidence_at_match")} AS confidence_at_match,
       first_opinion_stable, first_opinion_pair, first_correct_match, {rnd("opinion_dominance")} AS opinion_dominance,
       {rnd("opinion_confidence")} AS opinion_confidence, {rnd("correct_confidence")} AS correct_confidence
FROM emerged""",
)
def emergence(spark, sf_dir):
    out = T.emergence(_paths(spark, sf_dir, "opinion"))
    return out.select(
        "question_id",
        "follows_opinion",
        "first_opinion_match",
        r9("confidence_at_match").alias("confidence_at_match"),
        "first_opinion_stable",
        "first_opinion_pair",
        "first_correct_match",
        r9("opinion_dominance").alias("opinion_dominance"),
        r9("opinion_confidence").alias("opinion_confidence"),
        r9("correct_confidence").alias("correct_confidence"),
    )


@query(
    "emergence_summary",
    with_tables(LAYERS, _PATHS, _EMERGENCE)
    + f"""
SELECT follows_opinion, count(first_opinion_stable) AS n, {rnd("avg(first_opinion_stable)")} AS mean,
       {rnd("stddev_pop(first_opinion_stable)")} AS std, min(first_opinion_stable)::DOUBLE AS min,
       max(first_opinion_stable)::DOUBLE AS max, median(first_opinion_stable)::DOUBLE AS median
FROM emerged GROUP BY follows_opinion""",
)
def emergence_summary(spark, sf_dir):
    out = T.emergence(_paths(spark, sf_dir, "opinion")).select("follows_opinion", "first_opinion_stable")
    table = S.summary(out, ["follows_opinion"], "first_opinion_stable")
    return table.withColumn("mean", r9("mean")).withColumn("std", r9("std"))


@query(
    "opinion_rate_by_layer",
    with_tables(LAYERS, _PATHS)
    + f"""
SELECT layer AS position, {rnd("avg((pred = wrong_pos)::INT)")} AS opinion_rate, count(*) AS n
FROM framed WHERE condition = 'opinion' GROUP BY layer""",
)
def opinion_rate_by_layer(spark, sf_dir):
    return T.opinion_rate_by_position(_paths(spark, sf_dir, "opinion")).withColumn("opinion_rate", r9("opinion_rate"))


@query(
    "consistency_matrix",
    with_tables(LAYERS, _PATHS)
    + "SELECT question_id, layer, pred = final AS consistent FROM framed WHERE condition = 'opinion'",
)
def consistency_matrix(spark, sf_dir):
    return T.consistency(_paths(spark, sf_dir, "opinion"))


@query(
    "confidence_by_layer",
    with_tables(LAYERS, _softmax_sql("layers", ["plain", "opinion"], "0"))
    + f"""
SELECT condition, layer, {rnd("avg(right_p)")} AS correct_confidence, {rnd("avg(wrong_p)")} AS misleading_confidence, count(*) AS n
FROM (
  SELECT 'plain' AS condition, question_id, layer, max(plain_p) FILTER (pos = right_pos) AS right_p,
         max(plain_p) FILTER (pos <> right_pos) AS wrong_p FROM layers_p GROUP BY question_id, layer
  UNION ALL
  SELECT 'opinion', question_id, layer, max(opinion_p) FILTER (pos = right_pos),
         max(opinion_p) FILTER (pos = wrong_pos) FROM layers_p GROUP BY question_id, layer)
GROUP BY condition, layer""",
)
def confidence_by_layer(spark, sf_dir):
    parts = [
        T.confidence_by_layer(X.layer_table(spark, sf_dir, c)).withColumn("condition", F.lit(c))
        for c in ("plain", "opinion")
    ]
    out = parts[0].unionByName(parts[1])
    return out.select(
        "condition", "layer", r9("correct_confidence").alias("correct_confidence"),
        r9("misleading_confidence").alias("misleading_confidence"), "n",
    )


# --- significance ----------------------------------------------------------------------------

# Simpson's rule on the normal density, 2000 steps: another way to the same tail.
_TAIL = """greatest(0, 1 - 2 * {z} / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(i * {z} / 2000) * (i * {z} / 2000) / 2))))"""

_MEASURES = """
measured AS (
  SELECT 'stabilisation' AS measure, condition = 'opinion' AS second, stable::DOUBLE AS value FROM paths WHERE stable IS NOT NULL
  UNION ALL SELECT 'instability', condition = 'opinion', changes::DOUBLE FROM paths
  UNION ALL SELECT 'final_confidence', condition = 'opinion', final_conf FROM paths
),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY measure ORDER BY value) + (count(*) OVER (PARTITION BY measure, value) - 1) / 2.0 AS r,
         count(*) OVER (PARTITION BY measure, value) AS t
  FROM measured
),
tested AS (
  SELECT measure, count_if(NOT second)::BIGINT AS n1, count_if(second)::BIGINT AS n2,
         sum(r) FILTER (NOT second) - count_if(NOT second) * (count_if(NOT second) + 1) / 2.0 AS u,
         sum(t * t - 1) AS ties
  FROM ranked GROUP BY measure
),
scored AS (
  SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5)
    / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z
  FROM tested
)"""


def _measures(spark, sf_dir):
    both = None
    for condition in ("plain", "opinion"):
        part = _paths(spark, sf_dir, condition).select(
            F.lit(condition == "opinion").alias("second"),
            F.explode(
                F.array(
                    F.struct(F.lit("stabilisation").alias("measure"), F.col("stabilisation_layer").cast("double").alias("value")),
                    F.struct(F.lit("instability").alias("measure"), F.col("prediction_changes").cast("double").alias("value")),
                    F.struct(F.lit("final_confidence").alias("measure"), F.col("final_confidence").alias("value")),
                )
            ).alias("m"),
        )
        both = part if both is None else both.unionByName(part)
    return both.select("second", "m.measure", "m.value").where(F.col("value").isNotNull())


@query(
    "significance",
    with_tables(LAYERS, _PATHS, _MEASURES)
    + f"""
SELECT measure, n1, n2, {rnd("u", 6)} AS u, {rnd("z", 7)} AS z,
       {rnd("CASE WHEN z < 0 THEN 1 ELSE " + _TAIL.format(z="z") + " END", 7)} AS p_value
FROM scored""",
)
def significance(spark, sf_dir):
    """Mann–Whitney tests of the plain against the opinion trajectories."""
    out = S.mann_whitney(_measures(spark, sf_dir), ["measure"], "value", F.col("second"))
    return out.select(
        "measure", "n1", "n2", r9("u", 6).alias("u"), r9("z", 7).alias("z"), r9("p_value", 7).alias("p_value")
    )


@query(
    "effect_size",
    with_tables(LAYERS, _PATHS, _MEASURES)
    + f"""
SELECT measure, {rnd("avg(value) FILTER (NOT second)")} AS mean1, {rnd("avg(value) FILTER (second)")} AS mean2,
       {rnd("(avg(value) FILTER (second) - avg(value) FILTER (NOT second)) / stddev_pop(value)")} AS effect_size
FROM measured GROUP BY measure""",
)
def effect_size(spark, sf_dir):
    out = S.two_sample_summary(_measures(spark, sf_dir), ["measure"], "value", F.col("second"))
    return out.select("measure", *[r9(c).alias(c) for c in ("mean1", "mean2", "effect_size")])


@query(
    "trajectory_summary",
    with_tables(LAYERS, _PATHS, _MEASURES)
    + f"""
SELECT measure, count(value) AS n, {rnd("avg(value)")} AS mean, {rnd("stddev_pop(value)")} AS std,
       {rnd("min(value)")} AS min, {rnd("max(value)")} AS max, {rnd("median(value)")} AS median
FROM measured WHERE second GROUP BY measure""",
)
def trajectory_summary(spark, sf_dir):
    table = S.summary(_measures(spark, sf_dir).where("second"), ["measure"], "value")
    return table.select("measure", "n", *[r9(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query(
    "accuracy_chi_square",
    with_tables(LAYERS, _PATHS)
    + f""",
cells AS (
  SELECT question_id % 5 AS fold, count_if(condition = 'plain' AND final = right_pos)::DOUBLE AS a, count_if(condition = 'plain' AND final <> right_pos)::DOUBLE AS b,
         count_if(condition = 'opinion' AND final = right_pos)::DOUBLE AS c, count_if(condition = 'opinion' AND final <> right_pos)::DOUBLE AS d
  FROM paths GROUP BY fold
),
expected AS (
  SELECT *, (a + b) * (a + c) / (a + b + c + d) AS ea, (a + b) * (b + d) / (a + b + c + d) AS eb,
         (c + d) * (a + c) / (a + b + c + d) AS ec, (c + d) * (b + d) / (a + b + c + d) AS ed FROM cells
),
chi AS (
  SELECT *, power(abs(a - ea) - least(0.5, abs(a - ea)), 2) * (1 / ea + 1 / eb + 1 / ec + 1 / ed) AS chi2 FROM expected
)
SELECT fold, {rnd("a / (a + b)")} AS rate1, {rnd("c / (c + d)")} AS rate2, {rnd("chi2", 7)} AS chi2,
       {rnd(_TAIL.format(z="sqrt(chi2)"), 7)} AS p_value, {rnd("c / (c + d) - a / (a + b)")} AS effect_size
FROM chi""",
)
def accuracy_chi_square(spark, sf_dir):
    parts = [
        _paths(spark, sf_dir, c).select(
            (F.col("question_id") % 5).alias("fold"), "is_correct", F.lit(c == "opinion").alias("second")
        )
        for c in ("plain", "opinion")
    ]
    out = S.chi_square_2x2(parts[0].unionByName(parts[1]), ["fold"], F.col("is_correct"), F.col("second"))
    return out.select(
        "fold",
        r9("rate1").alias("rate1"),
        r9("rate2").alias("rate2"),
        r9("chi2", 7).alias("chi2"),
        r9("p_value", 7).alias("p_value"),
        r9("effect_size").alias("effect_size"),
    )


# --- probabilities of one row ----------------------------------------------------------------

@query(
    "answer_probabilities",
    with_tables(LAYERS)
    + f""",
last AS (
  SELECT question_id, pos, CASE WHEN question_id % 50 = 0 OR (question_id % 10 = 0 AND pos = 0) THEN NULL ELSE plain END AS v
  FROM layers WHERE layer = 15
),
shares AS (
  SELECT *, CASE WHEN question_id % 50 = 0 THEN 0.25 ELSE coalesce(exp(v) / sum(exp(v)) OVER (PARTITION BY question_id), 0) END AS p FROM last
)
SELECT question_id, {letter("pos")} AS letter, {rnd("p")} AS p FROM shares""",
)
def answer_probabilities(spark, sf_dir):
    """Last layer; some letters, and in some questions all of them, were never scored."""
    last = X.layer_table(spark, sf_dir, "plain").select("question_id", F.element_at("layers.logits", -1).alias("l"))
    lost = F.transform(
        "l",
        lambda v, i: F.when(
            (F.col("question_id") % 50 == 0) | ((F.col("question_id") % 10 == 0) & (i == 0)), F.lit(float("-inf"))
        ).otherwise(v),
    )
    rows = last.select("question_id", P.answer_probabilities(lost).alias("p"))
    return rows.select("question_id", F.posexplode("p").alias("pos", "p")).select(
        "question_id", letter_at(F.col("pos")).alias("letter"), r9("p").alias("p")
    )


@query(
    "top_tokens",
    f"""
WITH v AS (
  SELECT vec_id, p.pos, 10 * embedding[p.pos + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) p
),
s AS (
  SELECT *, exp(v - max(v) OVER g) / sum(exp(v - top)) OVER g AS p, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS rn
  FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM v) WINDOW g AS (PARTITION BY vec_id)
)
SELECT vec_id, {rnd("-sum(p * ln(p))")} AS entropy,
       string_agg(pos::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 5) AS tokens FROM s GROUP BY vec_id""",
)
def top_tokens(spark, sf_dir):
    """Entropy of the next-token distribution and its five best tokens."""
    rows = X.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: 10 * x).alias("logits")
    )
    best = F.array_join(F.transform(P.top_k(F.col("logits"), 5), lambda s: s["pos"].cast("string")), ",")
    return rows.select(
        "vec_id", r9(P.entropy(P.softmax(F.col("logits"), 0.0))).alias("entropy"), best.alias("tokens")
    )


@query(
    "stronger_token",
    with_tables(LAYERS)
    + f"""
SELECT question_id, layer, {letter("pos")} AS letter, {rnd("greatest(plain, opinion - 1.5)")} AS logit FROM layers""",
)
def stronger_token(spark, sf_dir):
    """Two readings of every letter, as a bare and as a space-prefixed token; the larger one counts."""
    rows = X.layer_runs(spark, sf_dir).select("question_id", F.inline("layers"))
    logits = F.zip_with("plain", "opinion", lambda bare, spaced: P.stronger_token(bare, spaced - 1.5))
    return rows.select("question_id", "layer", F.posexplode(logits).alias("pos", "logit")).select(
        "question_id", "layer", letter_at(F.col("pos")).alias("letter"), r9("logit").alias("logit")
    )
