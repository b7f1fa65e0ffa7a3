"""Reading and writing result tables. What used to be in file names is in partition columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Partition columns of a result table, outermost first (fixed values).
RUN_PARTITIONS = ("dataset", "condition", "model_id", "method_id", "data_seed")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, without files that cannot be read; an empty one with the schema if there is none."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_runs(df: DataFrame, path: str, partitions: Sequence[str] = RUN_PARTITIONS, mode: str = "append") -> None:
    """One folder per run; every task writes its own files, so a large run is many files and nothing is shuffled."""
    present = [p for p in partitions if p in df.columns]
    df.write.mode(mode).partitionBy(*present).parquet(path)


def write_states(df: DataFrame, path: str, key: str = "row_idx", seed: str = "data_seed", states: str = "layer_hidden_states") -> DataFrame:
    """Spill hidden states to a side table by seed; the rows come back without them.

    The side table is joined again by key and seed, so no row carries a path.
    """
    side = df.where(F.size(states) > 0).select(key, seed, states)
    side.write.mode("append").partitionBy(seed).parquet(path)
    return df.drop(states)


def with_states(df: DataFrame, spark: SparkSession, path: str, key: str = "row_idx", seed: str = "data_seed") -> DataFrame:
    return df.join(spark.read.parquet(path), [key, seed], "left")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header. The columns are those of the table, so a row with further keys loses none."""
    df.write.mode(mode).option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)
