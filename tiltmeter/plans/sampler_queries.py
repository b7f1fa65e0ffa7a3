"""Registered queries over the text corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.operators import samplers as S
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.registry import query
from tiltmeter.plans.sql import h, with_tables

SEED = 42
_SHUFFLE = h(f"'{SEED}'", "doc_id::VARCHAR")

_TOKENS = """
docs AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda t: t <> '') AS toks FROM documents
),
lens AS (SELECT doc_id, toks, len(toks) AS n FROM docs)"""

_PLACED = """
placed AS (SELECT doc_id, toks, n, sum(n) OVER (ORDER BY doc_id) - n AS off FROM lens WHERE n > 0),
total AS (SELECT sum(n) AS t FROM placed)"""


def _window_sql(n: int, seq: int) -> str:
    draw = h(f"'{SEED}'", "i::VARCHAR")
    return f"""
wins AS (SELECT i::INT AS sample, ({draw} % (t - {seq})::BIGINT) AS st FROM total, (SELECT unnest(range(0, {n})) AS i)),
cut AS (
  SELECT sample, off, toks[(greatest(st - off, 0) + 1)::BIGINT : least(st + {seq} - off, n)::BIGINT] AS part
  FROM placed JOIN wins ON off < st + {seq} AND off + n > st
)
SELECT sample, array_to_string(flatten(list(part ORDER BY off)), ' ') AS sample_text FROM cut GROUP BY sample"""


def _text(df, *keys):
    return df.select(*keys, F.array_join("tokens", " ").alias("sample_text"))


@query("calib_windows", with_tables(_TOKENS, _PLACED) + "," + _window_sql(128, 256))
def calib_windows(spark, sf_dir):
    return _text(S.random_windows(X.corpus(spark, sf_dir), 128, 256, SEED), "sample")


@query(
    "calib_sampled_texts",
    with_tables(_TOKENS.replace("FROM docs)", f"FROM docs ORDER BY {_SHUFFLE}, doc_id LIMIT 500)"), _PLACED) + "," + _window_sql(64, 128),
)
def calib_sampled_texts(spark, sf_dir):
    """The sampler that reads a sample of the texts of a corpus."""
    return _text(S.sampled_texts_windows(X.corpus(spark, sf_dir), 500, 64, 128, SEED), "sample")


@query(
    "calib_documents",
    with_tables(_TOKENS)
    + f""",
num AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS number, count(*) OVER () AS m FROM lens WHERE n >= 64),
draws AS (SELECT i::INT AS sample, {h(f"'{SEED}'", "i::VARCHAR", "'doc'")} AS a, {h(f"'{SEED}'", "i::VARCHAR", "'at'")} AS b
          FROM (SELECT unnest(range(0, 128)) AS i))
SELECT sample, doc_id, array_to_string(toks[(b % greatest(n - 64, 1) + 1)::BIGINT : (b % greatest(n - 64, 1) + 64)::BIGINT], ' ') AS sample_text
FROM draws JOIN num ON number = a % m""",
)
def calib_documents(spark, sf_dir):
    return _text(S.document_windows(X.corpus(spark, sf_dir), 128, 64, SEED), "sample", "doc_id")


@query(
    "calib_blocks",
    with_tables(_TOKENS)
    + f""",
chosen AS (SELECT *, {_SHUFFLE} AS hh FROM lens WHERE n BETWEEN 1 AND 512 ORDER BY hh, doc_id LIMIT 128),
one AS (SELECT flatten(list(toks ORDER BY hh, doc_id)) AS a FROM chosen)
SELECT b::INT AS block, array_to_string(a[b * 512 + 1 : (b + 1) * 512], ' ') AS sample_text
FROM (SELECT a, unnest(range(0, len(a) // 512)) AS b FROM one)""",
)
def calib_blocks(spark, sf_dir):
    return _text(S.short_text_blocks(X.corpus(spark, sf_dir), 128, 512, SEED), "block")


@query(
    "calib_truncated",
    with_tables(_TOKENS)
    + f"""
SELECT doc_id, array_to_string(toks[1:128], ' ') AS sample_text FROM lens ORDER BY {_SHUFFLE}, doc_id LIMIT 256""",
)
def calib_truncated(spark, sf_dir):
    return _text(S.truncated_texts(X.corpus(spark, sf_dir), 256, 128, SEED, full_only=False), "doc_id")


@query(
    "calib_full_length",
    with_tables(_TOKENS)
    + f"""
SELECT doc_id, array_to_string(toks[1:128], ' ') AS sample_text FROM lens WHERE n >= 128 ORDER BY {_SHUFFLE}, doc_id LIMIT 256""",
)
def calib_full_length(spark, sf_dir):
    return _text(S.truncated_texts(X.corpus(spark, sf_dir), 256, 128, SEED, full_only=True), "doc_id")


@query(
    "chat_truncate",
    f"""
WITH chosen AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY {h(f"'{SEED}'", "conv_id::VARCHAR")}, conv_id LIMIT 64),
marked AS (
  SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || ' <|im_end|>' || chr(10), '' ORDER BY turn) AS s
  FROM conversations WHERE conv_id IN (SELECT conv_id FROM chosen) GROUP BY conv_id
)
SELECT conv_id, array_to_string(list_filter(string_split_regex(s, '[\\t\\n\\x0B\\f\\r ]+'), lambda t: t <> '')[1:200], ' ') AS sample_text
FROM marked""",
)
def chat_truncate(spark, sf_dir):
    return _text(S.chat_texts(X.table(spark, sf_dir, "conversations"), 64, 200, SEED), "conv_id")


@query(
    "eval_blocks",
    with_tables(_TOKENS)
    + """,
words AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS pos, w
          FROM (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS k FROM lens)),
blocks AS (SELECT pos // 512 AS block, count(*) AS n, md5(string_agg(w, ' ' ORDER BY pos)) AS digest FROM words GROUP BY block)
SELECT block, n, digest FROM blocks WHERE n = 512""",
)
def eval_blocks(spark, sf_dir):
    """The whole corpus in blocks of 512 tokens, each by its digest."""
    blocks = S.corpus_blocks(X.corpus(spark, sf_dir), 512)
    return blocks.select(
        "block", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest")
    )


@query(
    "sample_batches",
    """
SELECT batch, count(*) AS n, sum(doc_id)::BIGINT AS id_sum
FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch FROM documents WHERE doc_id % 3 = 1)
GROUP BY batch""",
)
def sample_batches(spark, sf_dir):
    """Every third row, as one of three ranks reads it, in batches of four."""
    share = S.strided(X.corpus(spark, sf_dir), 1, 3, "doc_id").select("doc_id")
    return S.batches(share, 4, "doc_id").groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum")
    )
