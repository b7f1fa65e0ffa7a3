"""Declared schemas of the tables the engine consumes, and the checks that guard them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MCQ_RAW = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("answer", T.IntegerType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("method_id", T.StringType()),
        T.StructField("data_seed", T.LongType()),
        T.StructField("condition", T.StringType()),
        T.StructField("correct_answer_index", T.StringType()),
        T.StructField("chosen_wrong_answer_index", T.StringType()),
        T.StructField("model_answer", T.StringType()),
    ]
)

LAYER_LOGITS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))

CUSTOM_SAMPLES = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("negative_prompt", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("audio", T.StringType()),
    ]
)

# Columns that can identify a question, best first (fixed values).
QUESTION_KEYS = ("question_id", "id", "question", "query", "full_question")


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


class EmptyTable(ValueError):
    """No row is left where at least one is needed."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; every source column has to exist."""
    return require_columns(df, mapping.keys()).withColumnsRenamed(dict(mapping))


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Raise if the table is empty. Runs a one-row job, so call it at a boundary only."""
    if df.isEmpty():
        raise EmptyTable(f"{what} has no rows")
    return df


def question_key(df: DataFrame, index_col: str = "row_idx"):
    """Column that identifies a question: the best key present, else the explicit row index."""
    for name in QUESTION_KEYS:
        if name in df.columns:
            return F.col(name).cast("string")
    require_columns(df, [index_col], "table without a question key")
    return F.concat(F.lit("__idx__"), F.col(index_col).cast("string"))
