"""Question sets, calibration and evaluation texts by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.operators.samplers import corpus_blocks
from tiltmeter.schemas import MissingColumns, require_columns
from tiltmeter.session import settle

# Text column of each corpus (fixed values).
TEXT_COLUMNS = {"pileval": "text", "c4": "text", "wikitext2": "text", "ptb": "sentence", "ultrachat": "messages"}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines by ending, else Parquet."""
    return spark.read.json(path) if is_json(path) else spark.read.parquet(path)


def is_json(path: str) -> bool:
    return path.rstrip("/").removesuffix(".gz").endswith((".json", ".jsonl"))


def read_subsets(spark: SparkSession, whole: str, subsets: Sequence[str]) -> DataFrame:
    """The whole set from one place, or else the union of the subsets that are there.

    Parquet takes all paths in one scan, so the union of many subsets is one plan node.
    """

    def exists(path: str) -> bool:
        try:
            spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    if exists(whole):
        return spark.read.parquet(whole)
    present = [s for s in subsets if exists(s)]
    if not present:
        raise FileNotFoundError(f"neither {whole} nor any of {len(subsets)} subsets is there")
    return spark.read.option("mergeSchema", "true").parquet(*present)


#: Files whose starts are sent to every task; beyond that they are joined like any table.
FEW_FILES = 100_000


def with_row_index(spark: SparkSession, path: str, index: str = "row_idx") -> DataFrame:
    """A Parquet table with a dense index that follows file name and position in the file.

    Only the row counts of the files are ordered. Their starts go to every task if there are at most FEW_FILES of
    them, so the rows are read once and not moved.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # Counting needs no column of the table, so this reads the footers' row counts only.
    counts = settle(spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    joined = rows.join(F.broadcast(starts) if counts.count() <= FEW_FILES else starts, "_file")
    return joined.withColumn(index, F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


def calibration_texts(spark: SparkSession, name: str, path: str) -> DataFrame:
    """doc_id, text. Parquet without ids gets dense ones from file and position; JSON lines have to bring theirs."""
    column = TEXT_COLUMNS[name]
    df = require_columns(read_any(spark, path), [column], name)
    if "doc_id" not in df.columns:
        if is_json(path):
            raise MissingColumns(f"{path} has no doc_id, and lines of JSON have no position; write it as Parquet first")
        df = with_row_index(spark, path, "doc_id")
    return df.select("doc_id", F.col(column).alias("text"))


def evaluation_blocks(docs: DataFrame, seq_len: int) -> DataFrame:
    """Consecutive full blocks of the joined evaluation texts, whatever the corpus."""
    return corpus_blocks(docs, seq_len)


def custom_text(df: DataFrame) -> DataFrame:
    """Question and answer as one text."""
    answer = F.coalesce(F.col("answer"), F.lit("")) if "answer" in df.columns else F.lit("")
    return df.withColumn("text", F.concat(F.col("question"), answer))


def _below(folder: str, path: Column) -> Column:
    """Join folder and path; an absolute path stays."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def custom_samples(df: DataFrame, folder: str) -> DataFrame:
    """Fill missing text fields with '' and missing media with NULL, and put media paths below the folder."""
    out = df
    for name in ("question", "answer", "prompt", "negative_prompt"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit(""))
    for name in ("image", "audio"):
        if name not in df.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
        elif isinstance(df.schema[name].dataType, T.ArrayType):
            out = out.withColumn(name, F.transform(name, lambda p: _below(folder, p)))
        else:
            out = out.withColumn(name, _below(folder, F.col(name)))
    return out


def read_custom_samples(spark: SparkSession, folder: str) -> DataFrame:
    """``samples.json`` of a folder: one JSON array of records."""
    return custom_samples(spark.read.option("multiLine", "true").json(f"{folder.rstrip('/')}/samples.json"), folder)
