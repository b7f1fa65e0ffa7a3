"""What the corpus operators share: written tables, components of a link table, hashing of whole byte columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.session import checkpoint_dir

#: Words are runs of anything but these bytes. They never occur inside a longer UTF-8 sequence.
SPACE_PATTERN = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes hashed at once; a longer row makes a block of its own.
BLOCK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later jobs neither repeat nor depend on it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a batch between Spark and Python, for tables with whole texts.
BATCH_ROWS = 1024


def short_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of fewer rows than Spark's default, which counts on short ones.

    A setting of the session, not of a query: plans are only run later. A smaller one that is set already stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links ``a``, ``b``: the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, shortens the chains by pointer jumps and replaces the
    ends of the links by their roots; links inside one root fall away. Roots only get smaller, so the last root is
    the smallest node. A round at least halves the nodes that still have links. Hot nodes are met by partial minima
    and by joins that adaptive execution splits; no neighbourhood is ever collected. NULL ends link with nothing.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    live = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low"))
        # Written, so that the jump finds two shuffled sides and a root of very many nodes can be split.
        hooks = written(hooks.select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        hooks = written(_jump(_jump(hooks)))
        if labels is None:
            labels = hooks
        else:
            moved = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        labels = written(labels)
        roots = hooks.select("node", "root")
        for end in ("a", "b"):
            live = live.join(roots.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        live = live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        live = written(live.distinct())
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("root").alias("component"))


def _jump(hooks: DataFrame) -> DataFrame:
    """A node with a smaller neighbour may hang below another one; take the root's own root."""
    above = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return hooks.join(above, "root", "left").select("node", F.coalesce("further", "root").alias("root"))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text, NULL as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- whole byte columns in numpy


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row bounds within the bytes) for runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the finaliser of a public-domain split-mix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Fingerprints of any run of a sequence of 64-bit symbols, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.base = int(draw.integers(1 << 62, 1 << 63)) * 2 + 1
        self.table = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table ^= draw.integers(0, 1 << 63, 256, dtype=np.uint64)
        self.lower_table = self.table[_LOWER]
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, BLOCK_BYTES + 1)
            inverse = pow(self.base, -1, 1 << 64)
            for name, factor in (("powers", self.base), ("inverses", inverse)):
                steps = np.full(n, factor % (1 << 64), dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: 64-bit values; the sums start with 0."""
        self._reach(len(symbols) + 1)
        out = np.empty(len(symbols) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(symbols * self.powers[: len(symbols)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of symbols start..end-1; runs of other lengths differ."""
        raw = (prefix[end] - prefix[start]) * self.inverses[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def every(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of all runs of k symbols."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.inverses[:n] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))


def word_spans(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words end at the end of a row. ``space`` tells per byte value what is no word."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~space[data]
    starts = inside[1:-1] & ~inside[:-2]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[first] |= inside[1:-1][first]
    ends = inside[1:-1] & ~inside[2:]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    ends[last] |= inside[1:-1][last]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(bounds, start, side="right") - 1


def word_hashes(data: np.ndarray, spans, rolling: Rolling, lower: bool = False) -> np.ndarray:
    symbols = (rolling.lower_table if lower else rolling.table)[data]
    return rolling.runs(rolling.prefix(symbols), spans[0], spans[1])


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling; the keys carry their own position."""
    low, have = keys, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A to Z in lower case."""
    return _LOWER[data]


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
