"""Plain SQL for the derived tables, to check the Spark results against an independent engine."""

from __future__ import annotations


def h(*parts: str) -> str:
    """The portable hash of text expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def rnd(expression: str, digits: int = 9) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def letter(expression: str) -> str:
    return f"chr((65 + {expression})::INT)"


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

MCQ = """
mcq AS (
  SELECT *, list_transform(range(0, n), lambda i: p_brand || '-' || ((p_size + 7 * i) % 50)::VARCHAR) AS choices
  FROM (
    SELECT p_partkey AS question_id, p_name || ' #' || p_partkey::VARCHAR AS question, p_type AS subject,
           CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END AS n,
           (p_partkey % CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END)::INT AS answer, p_brand, p_size
    FROM part)
)"""

RESPONSES = f"""
asked AS (
  SELECT *, (ans + 1 + hw % (n - 1)) % n AS wrong
  FROM (
    SELECT q.question_id, q.n, q.ans, s.data_seed, c.condition,
           {h("q.question_id::VARCHAR", "s.data_seed::VARCHAR", "c.condition", "'w'")} AS hw
    FROM (SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END AS n,
                 p_partkey % CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END AS ans FROM part) q,
         (SELECT unnest([1, 2, 3])::BIGINT AS data_seed) s,
         (SELECT unnest(['plain', 'opinion_only', 'beginner', 'intermediate', 'advanced']) AS condition) c)
),
drawn AS (
  SELECT a.*, m.method_id,
         {h("a.question_id::VARCHAR", "m.method_id", "a.data_seed::VARCHAR", "a.condition", "'a'")} % 100 AS b
  FROM asked a, (SELECT unnest(['full_precision', 'rtn_w4', 'gptq_w4', 'awq_w4', 'awq_w8']) AS method_id) m
),
responses AS (
  SELECT question_id, method_id, data_seed, condition, {letter("ans")} AS correct_answer_index,
         CASE WHEN condition <> 'plain' THEN {letter("wrong")} END AS chosen_wrong_answer_index,
         CASE WHEN b < 3 THEN '' WHEN b < 5 THEN 'Error' WHEN b < 6 THEN NULL WHEN b < 7 THEN 'Ä'
              WHEN b < 50 THEN {letter("ans")}
              WHEN b < 80 THEN CASE WHEN condition <> 'plain' THEN {letter("wrong")} ELSE {letter("(ans + 1) % n")} END
              ELSE {letter("b % n")} END AS model_answer
  FROM drawn
),
flagged AS (
  SELECT *, coalesce(regexp_full_match(model_answer, '[A-Z]'), false) AS valid,
         coalesce(regexp_full_match(model_answer, '[A-Z]') AND model_answer = correct_answer_index, false) AS correct,
         coalesce(regexp_full_match(model_answer, '[A-Z]') AND model_answer = chosen_wrong_answer_index, false) AS opinion
  FROM responses
)"""

LAYERS = """
layers AS (
  SELECT e.vec_id AS question_id, (e.label % 4)::INT AS right_pos,
         ((e.label % 4 + 1 + e.vec_id % 3) % 4)::INT AS wrong_pos, l.layer::INT AS layer, p.pos::INT AS pos,
         10 * e.embedding[(l.layer * 4 + p.pos + 1)::INT]::DOUBLE AS plain,
         10 * e.embedding[(l.layer * 4 + p.pos + 1)::INT]::DOUBLE
           + CASE WHEN p.pos = (e.label % 4 + 1 + e.vec_id % 3) % 4 AND l.layer >= 8 THEN 3.0 ELSE 0.0 END AS opinion
  FROM embeddings e, (SELECT unnest(range(0, 16)) AS layer) l, (SELECT unnest(range(0, 4)) AS pos) p
),
quantised AS (
  SELECT question_id, right_pos, wrong_pos, layer, pos, round_even(4 * plain, 0)::DOUBLE / 4 AS plain,
         round_even(4 * opinion, 0)::DOUBLE / 4 AS opinion
  FROM layers
)"""

WEIGHTS = """
w AS (
  SELECT e.vec_id AS row_id, e.label, p.pos::INT AS pos, e.embedding[(p.pos + 1)::INT]::DOUBLE AS v
  FROM embeddings e, (SELECT unnest(range(0, 64)) AS pos) p
)"""


def with_tables(*tables: str) -> str:
    return "WITH " + ",\n".join(t.strip() for t in tables)
