"""Registered queries over what the sources do to their records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tiltmeter.functions.prob import total
from tiltmeter.operators.ordered import id_bucket, number_within
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.registry import query, r9
from tiltmeter.session import checkpoint_dir, settle
from tiltmeter.sources import corpora, tables, weights_file


@query(
    "custom_samples",
    """
SELECT page_id, url AS question, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'a' || page_id END AS answer, '' AS prompt,
       '' AS negative_prompt, 'set/one.png,/abs/' || page_id || '.png' AS image, NULL::VARCHAR AS audio,
       url || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'a' || page_id END AS text
FROM pages""",
)
def custom_samples(spark, sf_dir):
    """Records with missing fields and media paths below the folder of the set."""
    raw = X.table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("url").alias("question"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("a"), F.col("page_id").cast("string"))).alias("answer"),
        F.array(F.lit("one.png"), F.concat(F.lit("/abs/"), F.col("page_id").cast("string"), F.lit(".png"))).alias("image"),
    )
    filled = corpora.custom_text(corpora.custom_samples(raw, "set/"))
    return filled.withColumn("image", F.array_join("image", ","))


@query(
    "eval_short_blocks",
    """
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda t: t <> '') AS toks
  FROM documents),
words AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS pos, w
          FROM (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS k FROM docs)),
blocks AS (SELECT pos // 128 AS block, count(*) AS n, md5(string_agg(w, ' ' ORDER BY pos)) AS digest FROM words GROUP BY block)
SELECT block, digest FROM blocks WHERE n = 128""",
)
def eval_short_blocks(spark, sf_dir):
    """The whole evaluation corpus in blocks of 128 tokens."""
    blocks = corpora.evaluation_blocks(X.corpus(spark, sf_dir), 128)
    return blocks.select("block", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(
    "eval_whole_or_subsets",
    "SELECT * FROM (SELECT doc_id AS k, source AS name FROM documents UNION ALL SELECT page_id, url FROM pages)",
)
def eval_whole_or_subsets(spark, sf_dir):
    """A set that is there as a whole is read from one place; one that is not, from its subsets that are."""
    whole = corpora.read_subsets(spark, f"{sf_dir}/documents.parquet", [f"{sf_dir}/pages.parquet"])
    parts = corpora.read_subsets(spark, f"{sf_dir}/no_such.parquet", [f"{sf_dir}/missing.parquet", f"{sf_dir}/pages.parquet"])
    rows = whole.select(F.col("doc_id").alias("k"), F.col("source").alias("name"))
    return rows.unionByName(parts.select(F.col("page_id").alias("k"), F.col("url").alias("name")))


@query(
    "dense_row_index",
    "SELECT count(*) AS n, count(*) - 1 AS last, count(*) AS places, count(*) * (count(*) - 1) // 2 AS total FROM documents",
)
def dense_row_index(spark, sf_dir):
    """The numbers 0, 1, … in file order, without moving the rows."""
    rows = corpora.with_row_index(spark, f"{sf_dir}/documents.parquet")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("row_idx").alias("last"),
        F.count_distinct("row_idx").alias("places"),
        F.sum("row_idx").alias("total"),
    )


@query("tolerant_scan", "SELECT doc_id, lang FROM documents")
def tolerant_scan(spark, sf_dir):
    """A table that is there and one that is not, which counts as empty."""
    schema = X.table(spark, sf_dir, "documents").select("doc_id", "lang").schema
    there = tables.read_if_there(spark, f"{sf_dir}/documents.parquet", schema)
    return there.unionByName(tables.read_if_there(spark, f"{sf_dir}/no_such.parquet", schema))


@query(
    "weights_file_rows",
    """
SELECT 'layer.' || label || '.weight' AS tensor, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_id, len(embedding)::INT AS width,
  (round(list_sum(embedding::DOUBLE[]), 9) + 0.0) AS row_sum, (round(embedding[1]::DOUBLE, 9) + 0.0) AS first
FROM embeddings""",
)
def weights_file_rows(spark, sf_dir):
    """Matrices by label written as weight files, one a matrix, and read back in ranges of rows."""
    rows = X.weights(spark, sf_dir).withColumn("tensor", F.concat(F.lit("layer."), F.col("label").cast("string"), F.lit(".weight")))
    placed = number_within(rows, ["tensor"], [F.col("row_id")], id_bucket(rows, "row_id"), "place")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/weights/{uuid.uuid4().hex}"
    settle(weights_file.write_weights(placed.select("tensor", F.col("place").alias("row_id"), "w"), folder))
    back = weights_file.read_weights(spark, folder, range_bytes=1 << 20)
    return back.select("tensor", "row_id", F.size("w").alias("width"), r9(total(F.col("w"))).alias("row_sum"), r9(F.get("w", F.lit(0))).alias("first"))
