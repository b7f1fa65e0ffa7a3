"""The batch operators on rows as they arrive: running counts, retries, spilling, moving ranges and second moments."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tiltmeter.operators.gram import moment_schema, partial_moments
from tiltmeter.operators.ordered import attach
from tiltmeter.operators.ranges import moved, moving_parts
from tiltmeter.operators.rates import answer_counts, latest_attempts
from tiltmeter.session import checkpoint_dir


def running_counts(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answer counts per run over everything seen so far. The state is one row per run."""
    return answer_counts(answers, keys)


def standing_answers(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The answer that stands per question while retries come in."""
    return latest_attempts(attempts, keys)


def spill(stream: DataFrame, path: str, checkpoint: str, partition: str = "data_seed") -> StreamingQuery:
    """Append every micro-batch to a partitioned table; the checkpoint keeps a restart from writing twice."""
    writer = stream.writeStream.format("parquet").partitionBy(partition).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(path)


def batch_ranges_of(rows: DataFrame, keys: Sequence[str], batch: str, values: str = "x") -> DataFrame:
    """Per row the range of its values, for a stream in which a row is a batch."""
    return rows.select(*keys, batch, F.array_min(values).alias("low"), F.array_max(values).alias("high"))


def stream_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, for the state and the result of a stream."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def run_batches(stream: DataFrame, folder: str, mode: str, use: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now. Its progress lies in the folder, so a restart goes on behind it."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).foreachBatch(use).start().awaitTermination()


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the batches wrote, with the number of each; empty if there was none."""
    with_batch = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    try:
        return spark.read.schema(with_batch).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], with_batch)


def standing_table(stream: DataFrame, folder: str) -> DataFrame:
    """The whole result of a grouped stream after its last batch, as a table in the folder.

    Each batch replaces what an earlier attempt at it wrote; the last batch holds the result.
    """

    def put(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/result/_batch={batch_id}")

    run_batches(stream, folder, "complete", put)
    written = stored(stream.sparkSession, f"{folder}/result", stream.schema)
    last = written.agg(F.max("_batch").alias("_last"))
    return attach(written, last).where("_batch = _last").drop("_batch", "_last")


def moving_range_table(ranges: DataFrame, keys: Sequence[str], alpha: float, folder: str, batch: str = "batch") -> DataFrame:
    """Exponentially moving (low, high) per key over batch ranges that arrive in batch order.

    A micro-batch is folded as one weighted sum per key, spread over the cluster, and met with the range of the key
    before it. The state is a row per key in the folder, written once per micro-batch that has the key.
    """
    keys = list(keys)
    fields = [T.StructField(k, ranges.schema[k].dataType) for k in keys]
    state = T.StructType([*fields, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])

    def latest(spark: SparkSession, below: int | None) -> DataFrame:
        rows = stored(spark, f"{folder}/state", state)
        rows = rows if below is None else rows.where(F.col("_batch") < below)
        best = rows.groupBy(*keys).agg(F.max_by(F.struct("low", "high"), "_batch").alias("_s"))
        return best.select(*keys, F.col("_s.low").alias("_low"), F.col("_s.high").alias("_high"))

    def fold(df: DataFrame, batch_id: int) -> None:
        parts = moving_parts(df, keys, batch, alpha).join(latest(df.sparkSession, batch_id), keys, "left")
        after = moved(parts, keys, alpha, F.col("_low"), F.col("_high"))
        after.write.mode("overwrite").parquet(f"{folder}/state/_batch={batch_id}")

    run_batches(ranges, folder, "append", fold)
    return latest(ranges.sparkSession, None).withColumnsRenamed({"_low": "low", "_high": "high"})


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningSum(StatefulProcessor):
    """A row of a matrix of second moments, added up over all micro-batches. The state is as wide as a row."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "h array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = np.asarray(self.sums.get()[0], dtype="float64") if self.sums.exists() else 0.0
        for pdf in rows:
            total = total + np.sum([np.asarray(h, dtype="float64") for h in pdf["h"]], axis=0)
        self.sums.update((total.tolist(),))
        fixed = {k: pd.Series([None if pd.isna(v) else v], dtype="object") for k, v in zip([*self.keys, "i"], key)}
        yield pd.DataFrame({**fixed, "h": [total.tolist()]})

    def close(self) -> None:
        pass


def running_gram(activations: DataFrame, folder: str, values: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """keys…, i, h: the second moments of everything that has come in, a matrix per key.

    A micro-batch is added up per task first, as in the batch operator; only row sums meet the state, which the engine
    keeps row by row in its store and snapshots with the progress of the stream. Rows that did not change are not
    written again. A restart with the same folder goes on where it was.
    """
    spark, keys = activations.sparkSession, list(keys)
    schema = moment_schema(activations, keys)
    parts = partial_moments(activations, values, keys)
    sums = parts.groupBy(*keys, "i").transformWithStateInPandas(RunningSum(keys), schema, "Update", "None")

    def put(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/result/_batch={batch_id}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        run_batches(sums, folder, "update", put)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    rows = stored(spark, f"{folder}/result", schema)
    return rows.groupBy(*keys, "i").agg(F.max_by("h", "_batch").alias("h"))
