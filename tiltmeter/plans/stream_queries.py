"""Registered queries that run as streams over the files of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.operators import rates as R
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.kernel_queries import _GRAM_BY_LABEL
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.sql import WEIGHTS, rnd, with_tables
from tiltmeter.streaming import live


def _stream(spark, sf_dir, name):
    schema = X.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


@query(
    "stream_rates",
    f"""
SELECT l_linestatus, count(*) AS n_total, {rnd("avg((l_returnflag = 'N')::INT)")} AS accuracy,
       {rnd("avg((l_returnflag = 'R')::INT)")} AS opinion_rate FROM lineitem GROUP BY l_linestatus""",
)
def stream_rates(spark, sf_dir):
    """Running answer counts of a stream, read once everything there has come in."""
    answers = _stream(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.col("l_returnflag").alias("model_answer"),
        F.lit("N").alias("correct_answer_index"),
        F.lit("R").alias("chosen_wrong_answer_index"),
    )
    counts = live.standing_table(live.running_counts(answers, ["l_linestatus"]), live.stream_folder(spark))
    return counts.select(
        "l_linestatus",
        "n_total",
        r9(R.share("n_correct")).alias("accuracy"),
        r9(R.share("n_opinion")).alias("opinion_rate"),
    )


@query(
    "stream_attempts",
    """
WITH a AS (
  SELECT conv_id % 97 AS question_id, conv_id * 1000 + turn AS attempt, CASE WHEN text[1] BETWEEN 'A' AND 'Z' THEN text[1] ELSE '' END AS model_answer
  FROM conversations)
SELECT question_id, attempt, model_answer FROM a
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY model_answer <> '' DESC, CASE WHEN model_answer <> '' THEN attempt ELSE -attempt END) = 1""",
)
def stream_attempts(spark, sf_dir):
    """Turns as attempts at a question; the first one that starts with a capital stands."""
    first = F.substring("text", 1, 1)
    attempts = _stream(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 97).alias("question_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("attempt"),
        F.when(F.regexp_like(first, F.lit("^[A-Z]$")), first).otherwise("").alias("model_answer"),
    )
    out = live.standing_table(live.standing_answers(attempts, ["question_id"]), live.stream_folder(spark))
    return out.select("question_id", "attempt", "model_answer")


@query(
    "stream_moving_range",
    f"""
SELECT label AS input, {rnd("list_reduce(list(lo ORDER BY vec_id), lambda m, x: m + 0.01 * (x - m))")} AS low,
       {rnd("list_reduce(list(hi ORDER BY vec_id), lambda m, x: m + 0.01 * (x - m))")} AS high
FROM (SELECT label, vec_id, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings) GROUP BY label""",
)
def stream_moving_range(spark, sf_dir):
    """Every vector a batch of its label's input, in order of its id."""
    rows = _stream(spark, sf_dir, "embeddings").select(
        F.col("label").alias("input"), F.col("vec_id").alias("batch"), F.col("embedding").cast("array<double>").alias("x")
    )
    ranges = live.batch_ranges_of(rows, ["input"], "batch")
    out = live.moving_range_table(ranges, ["input"], 0.01, live.stream_folder(spark))
    return out.select("input", r9("low").alias("low"), r9("high").alias("high"))


@query("stream_gram", with_tables(WEIGHTS, _GRAM_BY_LABEL) + f"SELECT label, i, j, {rnd('h')} AS h FROM h")
def stream_gram(spark, sf_dir):
    """The matrices of all labels, row sums kept as state while vectors come in."""
    rows = _stream(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    out = live.running_gram(rows, live.stream_folder(spark), keys=["label"])
    return out.select("label", "i", F.posexplode("h").alias("j", "h")).withColumn("h", r9("h"))
