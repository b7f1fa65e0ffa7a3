"""Registered queries over answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions.answers import (
    FALLBACK_LETTERS,
    extract_letter,
    letter_of_token,
)
from tiltmeter.operators import rates as R
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.registry import query, r9
from tiltmeter.plans.sql import RESPONSES, SPACES, rnd, with_tables
from tiltmeter.session import spread

_TRIPLE_SQL = f"""
  {{keys}}, {rnd("avg(correct::INT)")} AS accuracy, {rnd("avg(opinion::INT)")} AS opinion_rate,
  {rnd("avg((NOT correct AND NOT opinion)::INT)")} AS error_rate"""


def _rounded(df, *measures):
    for m in measures or ("accuracy", "opinion_rate", "error_rate"):
        df = df.withColumn(m, r9(m))
    return df


_RUN_RATES = f"""
runs AS (
  SELECT method_id, data_seed, condition, avg(correct::INT) AS accuracy, avg(opinion::INT) AS opinion_rate,
         avg((NOT correct AND NOT opinion)::INT) AS error_rate
  FROM flagged WHERE valid GROUP BY ALL
)"""


@query(
    "opinion_rate_by_run",
    with_tables(RESPONSES, _RUN_RATES)
    + f"""
SELECT method_id, condition, {rnd("avg(accuracy)")} AS accuracy, {rnd("avg(opinion_rate)")} AS opinion_rate,
       {rnd("avg(error_rate)")} AS error_rate, count(*) AS n_seeds
FROM runs GROUP BY method_id, condition""",
)
def opinion_rate_by_run(spark, sf_dir):
    runs = R.rate_triple(X.responses(spark, sf_dir))
    return _rounded(R.seed_average(runs, ["method_id", "condition"]))


@query(
    "rate_triple",
    with_tables(RESPONSES)
    + "SELECT "
    + _TRIPLE_SQL.format(keys="method_id, data_seed, condition")
    + " FROM flagged WHERE valid GROUP BY method_id, data_seed, condition",
)
def rate_triple(spark, sf_dir):
    return _rounded(R.rate_triple(X.responses(spark, sf_dir)))


@query(
    "valid_ratio",
    with_tables(RESPONSES)
    + f"""
SELECT method_id, condition, count(*) AS n_total, count_if(valid)::BIGINT AS n_valid,
       count_if(coalesce(regexp_full_match(model_answer, '\\p{{Lu}}'), false))::BIGINT AS n_valid_any_script, {rnd("count_if(valid) / count(*)")} AS valid_ratio
FROM flagged GROUP BY method_id, condition""",
)
def valid_ratio(spark, sf_dir):
    return R.validity(X.responses(spark, sf_dir), ["method_id", "condition"]).withColumn(
        "valid_ratio", r9("valid_ratio")
    )


@query(
    "guarded_rates",
    with_tables(RESPONSES)
    + f"""
SELECT method_id, data_seed, condition, count(*) AS n_total, count_if(valid)::BIGINT AS n_valid,
       count_if(correct)::BIGINT AS n_correct, count_if(opinion)::BIGINT AS n_opinion,
       count_if(valid AND NOT correct AND NOT opinion)::BIGINT AS n_other,
       {rnd("coalesce(count_if(correct) / nullif(count_if(valid), 0), 0)")} AS correct_rate,
       {rnd("coalesce(count_if(opinion) / nullif(count_if(valid), 0), 0)")} AS opinion_rate,
       {rnd("coalesce(count_if(valid AND NOT correct AND NOT opinion) / nullif(count_if(valid), 0), 0)")} AS other_rate
FROM flagged GROUP BY method_id, data_seed, condition""",
)
def guarded_rates(spark, sf_dir):
    out = R.guarded_rates(X.responses(spark, sf_dir), ["method_id", "data_seed", "condition"])
    return _rounded(out, "correct_rate", "opinion_rate", "other_rate")


@query(
    "plain_accuracy",
    with_tables(RESPONSES)
    + f"""
SELECT method_id, data_seed, {rnd("avg(correct::INT)")} AS accuracy, {rnd("avg(0)")} AS opinion_rate,
       {rnd("1 - avg(correct::INT)")} AS error_rate
FROM flagged WHERE valid AND condition = 'plain' GROUP BY method_id, data_seed""",
)
def plain_accuracy(spark, sf_dir):
    """A table without suggested letters: nothing follows an opinion and the rest is error."""
    plain = X.responses(spark, sf_dir, conditions=("plain",)).drop("chosen_wrong_answer_index")
    return _rounded(R.rate_triple(plain, ["method_id", "data_seed"]))


@query(
    "accuracy_controlled_rate",
    with_tables(RESPONSES)
    + f""",
known AS (SELECT DISTINCT question_id, method_id, data_seed FROM flagged WHERE condition = 'plain' AND correct),
shared AS (
  SELECT k.* FROM known k
  JOIN (SELECT question_id, data_seed FROM known WHERE method_id = 'full_precision') b USING (question_id, data_seed)
),
per_seed AS (
  SELECT method_id, data_seed, count(*) AS n_valid, avg(correct::INT) AS accuracy, avg(opinion::INT) AS opinion_rate,
         avg((NOT correct AND NOT opinion)::INT) AS error_rate
  FROM flagged WHERE valid AND condition = 'opinion_only'
    AND (question_id, method_id, data_seed) IN (SELECT (question_id, method_id, data_seed) FROM shared)
  GROUP BY method_id, data_seed
)
SELECT p.method_id, p.data_seed, s.n_shared, p.n_valid, {rnd("accuracy")} AS accuracy,
       {rnd("opinion_rate")} AS opinion_rate, {rnd("error_rate")} AS error_rate
FROM per_seed p JOIN (SELECT method_id, data_seed, count(*) AS n_shared FROM shared GROUP BY ALL) s
  USING (method_id, data_seed)""",
)
def accuracy_controlled_rate(spark, sf_dir):
    return _rounded(R.accuracy_controlled_rates(X.responses(spark, sf_dir)))


@query(
    "shared_correct_keys",
    with_tables(RESPONSES)
    + """
SELECT method_id, data_seed, count(*) AS n_shared, sum(question_id)::BIGINT AS key_sum
FROM (SELECT DISTINCT question_id, method_id, data_seed FROM flagged WHERE condition = 'plain' AND correct) k
WHERE (question_id, data_seed) IN (
  SELECT (question_id, data_seed) FROM flagged
  WHERE condition = 'plain' AND correct AND method_id = 'full_precision')
GROUP BY method_id, data_seed""",
)
def shared_correct_keys(spark, sf_dir):
    keys = R.shared_correct_keys(X.responses(spark, sf_dir))
    return keys.groupBy("method_id", "data_seed").agg(
        F.count(F.lit(1)).alias("n_shared"), F.sum(F.col("key").cast("bigint")).alias("key_sum")
    )


@query(
    "authority_levels",
    with_tables(RESPONSES, _RUN_RATES)
    + f"""
SELECT method_id, condition, {rnd("avg(accuracy)")} AS accuracy, {rnd("avg(opinion_rate)")} AS opinion_rate,
       {rnd("avg(error_rate)")} AS error_rate, count(*) AS n_seeds
FROM runs WHERE condition IN ('beginner', 'intermediate', 'advanced') GROUP BY method_id, condition""",
)
def authority_levels(spark, sf_dir):
    runs = R.rate_triple(X.responses(spark, sf_dir, conditions=X.LEVELS))
    return _rounded(R.seed_average(runs, ["method_id", "condition"]))


@query(
    "complete_seed_average",
    with_tables(RESPONSES, _RUN_RATES)
    + f""",
present AS (
  SELECT * FROM runs WHERE NOT (method_id = 'rtn_w4' AND data_seed = 2 AND condition = 'opinion_only')
),
complete AS (
  SELECT method_id, data_seed FROM present WHERE condition IN ('plain', 'opinion_only')
  GROUP BY ALL HAVING count(DISTINCT condition) = 2
)
SELECT method_id, condition, {rnd("avg(accuracy)")} AS accuracy, {rnd("avg(opinion_rate)")} AS opinion_rate,
       {rnd("avg(error_rate)")} AS error_rate, count(*) AS n_seeds
FROM present JOIN complete USING (method_id, data_seed)
WHERE condition IN ('plain', 'opinion_only') GROUP BY method_id, condition""",
)
def complete_seed_average(spark, sf_dir):
    """One run is missing, so its seed drops out of both conditions of that method."""
    answers = X.responses(spark, sf_dir).where(
        ~((F.col("method_id") == "rtn_w4") & (F.col("data_seed") == 2) & (F.col("condition") == "opinion_only"))
    )
    runs = R.complete_seeds(R.rate_triple(answers), ["plain", "opinion_only"])
    return _rounded(R.seed_average(runs, ["method_id", "condition"]))


@query(
    "rate_at_volume",
    f"""
SELECT l_linestatus, count(*) AS n_total, count_if(l_returnflag ~ '^[A-Z]$')::BIGINT AS n_valid,
       {rnd("avg((l_returnflag = 'N')::INT)")} AS accuracy, {rnd("avg((l_returnflag = 'R')::INT)")} AS opinion_rate,
       {rnd("avg((l_returnflag NOT IN ('N', 'R'))::INT)")} AS error_rate
FROM lineitem GROUP BY l_linestatus""",
)
def rate_at_volume(spark, sf_dir):
    """Item flags as answers: N is right, R is suggested."""
    answers = X.table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.col("l_returnflag").alias("model_answer"),
        F.lit("N").alias("correct_answer_index"),
        F.lit("R").alias("chosen_wrong_answer_index"),
    )
    counts = R.answer_counts(answers, ["l_linestatus"])
    return counts.select(
        "l_linestatus",
        "n_total",
        "n_valid",
        r9(R.share("n_correct")).alias("accuracy"),
        r9(R.share("n_opinion")).alias("opinion_rate"),
        r9(R.share("n_other")).alias("error_rate"),
    )


@query(
    "latest_attempt",
    with_tables(RESPONSES)
    + """,
attempts AS (
  SELECT question_id, condition, data_seed AS attempt, model_answer, valid FROM flagged WHERE method_id = 'rtn_w4'
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, condition
    ORDER BY valid DESC, CASE WHEN valid THEN attempt ELSE -attempt END) AS rn FROM attempts
)
SELECT condition, attempt, count(*) AS n, count_if(valid)::BIGINT AS n_valid, sum(question_id)::BIGINT AS key_sum
FROM ranked WHERE rn = 1 GROUP BY condition, attempt""",
)
def latest_attempt(spark, sf_dir):
    """Seeds stand in for retries of the same question."""
    attempts = X.responses(spark, sf_dir, methods=("rtn_w4",)).withColumnRenamed("data_seed", "attempt")
    final = R.latest_attempts(attempts, ["question_id", "condition"])
    return final.groupBy("condition", "attempt").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.regexp_like("model_answer", F.lit("^[A-Z]$")), F.lit(False))).alias("n_valid"),
        F.sum("question_id").alias("key_sum"),
    )


# RE2 has no look-around: every character that is not a letter becomes a blank, the words are taken
# apart, and a word that is one of the allowed capitals is a letter that stands alone.
_EXTRACT_SQL = f"""
t AS (SELECT *, trim(text, {SPACES}) AS s FROM raw),
parts AS (
  SELECT *, regexp_extract(s, '\\{{([A-Z])\\}}', 1) AS braced,
         list_filter(string_split_regex(s, '[^A-Za-z]+'), lambda x: x IN ('A', 'B', 'C', 'D')) AS alone
  FROM t
),
letters AS (
  SELECT *, CASE WHEN braced IN ('A', 'B', 'C', 'D') THEN braced ELSE coalesce(alone[1], '') END AS letter FROM parts
)"""


@query(
    "answer_letter_extraction",
    with_tables(
        """raw AS (
  SELECT conv_id AS id, turn AS part, text FROM conversations
  UNION ALL SELECT doc_id, -1, text FROM documents
  UNION ALL SELECT doc_id, -2, 'so {' || chr((65 + doc_id % 6)::INT) || '} then ' || chr((65 + doc_id % 5)::INT) || '.'
            FROM documents)""",
        _EXTRACT_SQL,
    )
    + "SELECT id, part, letter FROM letters",
)
def answer_letter_extraction(spark, sf_dir):
    chats = spread(X.table(spark, sf_dir, "conversations")).select(
        F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text"
    )
    docs = spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = docs.select(F.col("doc_id").alias("id"), F.lit(-1).cast("bigint").alias("part"), "text")
    braced = docs.select(
        F.col("doc_id").alias("id"),
        F.lit(-2).cast("bigint").alias("part"),
        F.concat(
            F.lit("so {"),
            F.chr((65 + F.col("doc_id") % 6).cast("int")),
            F.lit("} then "),
            F.chr((65 + F.col("doc_id") % 5).cast("int")),
            F.lit("."),
        ).alias("text"),
    )
    allowed = X.literals(FALLBACK_LETTERS)
    return chats.unionByName(plain).unionByName(braced).select(
        "id", "part", extract_letter(F.col("text"), allowed).alias("letter")
    )


@query(
    "token_letter",
    with_tables(
        f"raw AS (SELECT conv_id AS id, turn AS part, trim(text, {SPACES}) AS s FROM conversations)"
    )
    + """
SELECT id, part, CASE WHEN s[1] IN ('A', 'B', 'C', 'D') THEN s[1] ELSE '' END AS letter FROM raw""",
)
def token_letter(spark, sf_dir):
    return X.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"),
        F.col("turn").alias("part"),
        letter_of_token(F.col("text"), X.literals(FALLBACK_LETTERS)).alias("letter"),
    )


@query(
    "invalid_answers",
    with_tables(RESPONSES)
    + """
SELECT question_id, method_id, data_seed, condition, model_answer FROM flagged WHERE NOT valid""",
)
def invalid_answers(spark, sf_dir):
    """Every unusable answer with its run."""
    return R.invalid_answers(X.responses(spark, sf_dir), ["question_id", "method_id", "data_seed", "condition"])
