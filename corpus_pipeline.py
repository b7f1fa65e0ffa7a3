"""The corpus pipeline: five stages over ``documents``, each reading what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``
and may be written and read again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm import byte_gru, chosen_path, mixing, packing, templates
from tiltmeter.llm.common import written
from tiltmeter.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is only believed with at least this mean probability; a guess among four has a quarter.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, which becomes their ``lang``.

    Texts without a letter (and NULL ones) and texts that the network cannot place are rejected. The network learns
    from the labelled documents that the stage itself is given. No labels at all: nothing can be recognised and every
    document is rejected.
    """
    langs, network = byte_gru.learn(docs)
    judged = byte_gru.predict(docs.select(*COLUMNS), langs, network)
    kept = judged.where((F.col("lang_pred") != byte_gru.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines are dropped from all documents but the first; a document left without a word goes."""
    kept = templates.drop_recurring_lines(docs.select(*COLUMNS))
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays. Rows that share an id are told apart by their text, so only those that are near
    duplicates of each other become one; equal rows are one document. Rows without an id link with nothing and stay.
    """
    docs = docs.select(*COLUMNS)
    # In the order of the ids: the id, then 60 bits of its text.
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 4).cast("decimal(19, 0)")
    node = (F.col("doc_id").cast("decimal(19, 0)") * F.lit(1 << 60).cast("decimal(19, 0)") + by_text).cast("decimal(38, 0)")
    rows = docs.where("doc_id is not null").withColumn("node", node)
    found = chosen_path.near_duplicates(rows, percent=80, id_col="node").where("kept").select(F.col("doc_id").alias("node")).distinct()
    first = rows.join(found, "node").groupBy("node").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return first.select("row.*").unionByName(docs.where("doc_id is null"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target shares of words."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

#: The network, the packing and the search are no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
