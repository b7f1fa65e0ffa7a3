"""Key caches: chunks kept whole, keys turned to new positions, keys of low rank.

A sequence is a row with ``tokens`` ARRAY<ARRAY<DOUBLE>>, as in :mod:`tiltmeter.operators.reduce`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.functions.vectors import bound, cosine, dot
from tiltmeter.operators.factors import by_keys
from tiltmeter.operators.gram import gram
from tiltmeter.operators.reduce import best_positions

# --- chunks -----------------------------------------------------------------------------------


def chunk_marks(tokens: Column, size: int) -> Column:
    """ARRAY of struct(mark, likeness): per whole chunk its mean key, and the cosine of the key least like it."""

    def one(chunk: Column) -> Column:
        start = F.transform(F.get(chunk, F.lit(0)), lambda x: F.lit(0.0))
        mean = F.aggregate(chunk, start, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b / size))
        return bound(mean, lambda m: F.struct(m.alias("mark"), F.array_min(F.transform(chunk, lambda t: cosine(m, t))).alias("likeness")))

    count = F.floor(F.size(tokens) / size).cast("int")
    places = F.filter(F.sequence(F.lit(0), count), lambda c: c < count)
    return F.transform(places, lambda c: one(F.slice(tokens, c * size + 1, F.lit(size))))


def chunk_index(tokens: Column, size: int, whole: int) -> Column:
    """struct(outliers, rest, marks): the ``whole`` chunks whose least likely key is least like their mark stay as they
    are; the others are looked up by their marks. Earlier chunks win ties; tokens behind the last whole chunk belong to none.
    """

    def split(marks: Column) -> Column:
        outliers = best_positions(F.transform(marks, lambda m: m["likeness"]), F.lit(whole), largest=False)

        def with_rest(out: Column) -> Column:
            rest = F.filter(F.transform(marks, lambda _, i: i), lambda i: ~F.array_contains(out, i))
            return F.struct(out.alias("outliers"), rest.alias("rest"), marks.alias("marks"))

        return bound(outliers, with_rest)

    return bound(chunk_marks(tokens, size), split)


def fetched_chunks(index: Column, query: Column, k: int) -> Column:
    """Of the chunks with marks, the ``k`` that the query attends to most; softmax keeps the order of dot products."""
    scores = F.transform(index["rest"], lambda c: dot(F.get(index["marks"], c)["mark"], query))
    return F.transform(best_positions(scores, F.lit(k)), lambda i: F.get(index["rest"], i))


# --- positions --------------------------------------------------------------------------------

ROTARY_BASE = 10000.0


def turned(vector: Column, steps: Column, turned_size: int | None = None, base: float = ROTARY_BASE) -> Column:
    """A key moved on by ``steps`` positions: place i and place i + d/2 turn together by steps / base^(2i/d).

    ``turned_size`` places from the front turn, the others stay. Turns add up, so a key at position p moves to p' by p' - p.
    """

    def turn(size: Column) -> Column:
        half = (size / 2).cast("int")

        def one(x: Column, j: Column) -> Column:
            i = j % half
            angle = steps * F.pow(F.lit(base), -2.0 * i / size)
            other = F.get(vector, F.when(j < half, j + half).otherwise(j - half))
            return F.when(j >= size, x).otherwise(x * F.cos(angle) + F.when(j < half, -other).otherwise(other) * F.sin(angle))

        return F.transform(vector, one)

    return bound(F.lit(turned_size) if turned_size else F.size(vector), turn)


def moved_window(tokens: Column, sinks: int, window: int, incoming: int, turned_size: int | None = None, base: float = ROTARY_BASE) -> Column:
    """The cache after ``incoming`` further keys: the first ``sinks`` stay, the last of the others make room.

    ``tokens`` holds the turned keys of the positions 0, 1, … of a cache that is full with ``window`` keys; what moves to
    the front is turned by the difference of positions. Shorter caches have room and stay as they are.
    """
    n = F.size(tokens)
    kept = F.slice(tokens, sinks + incoming + 1, F.greatest(n - sinks - incoming, F.lit(0)))
    moved = F.concat(F.slice(tokens, 1, sinks), F.transform(kept, lambda t: turned(t, F.lit(-float(incoming)), turned_size, base)))
    return F.when(n + incoming < window, tokens).otherwise(moved)


# --- low rank ---------------------------------------------------------------------------------


def key_basis(keys_table: DataFrame, ranks: Sequence[int], values: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """keys…, rank, lost, basis: the best directions of the keys of a matrix and the squares that they leave out.

    The right singular vectors of the keys are the eigenvectors of their second moments, which add up over tasks; only
    these, as wide as a key squared, are decomposed, one matrix to a task. ``basis`` has one direction a row, the first of
    the most weight, with its largest component positive.
    """
    keys = list(keys)
    h = gram(keys_table, values, keys)
    fields = [T.StructField(k, h.schema[k].dataType) for k in keys]
    fields += [T.StructField("rank", T.IntegerType()), T.StructField("lost", T.DoubleType())]
    schema = T.StructType([*fields, T.StructField("basis", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.asarray(r, dtype=np.float64) for r in pdf.sort_values("i")["h"]])
        weight, ways = np.linalg.eigh(m)
        weight, ways = np.maximum(weight[::-1], 0.0), ways[:, ::-1].T
        ways = ways * np.sign(ways[np.arange(len(ways)), np.abs(ways).argmax(axis=1)])[:, None]
        some = [min(r, len(m)) for r in ranks]
        out = pd.DataFrame({"rank": np.array(some, dtype="int32"), "lost": [float(weight[r:].sum()) for r in some]})
        out["basis"] = [[[float(x) for x in way] for way in ways[:r]] for r in some]
        for k in keys:
            out[k] = pd.Series([None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0]] * len(some), dtype="object")
        return out[[*keys, "rank", "lost", "basis"]]

    if keys:
        return h.groupBy(*keys).applyInPandas(lambda pdf: decompose(pdf), schema)
    return h.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda pdf: decompose(pdf), schema)


def low_rank_keys(rows: DataFrame, basis: DataFrame, values: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """The rows with ``rank``, ``low`` (the shares of the directions) and ``rebuilt``, the key made of them again.

    A row comes once for every rank that ``basis`` holds for its matrix.
    """
    joined = by_keys(rows, basis.select(*keys, "rank", "basis"), keys)
    shares = joined.withColumn("low", F.transform("basis", lambda way: dot(F.col(values), way)))
    start = F.transform(values, lambda x: F.lit(0.0))
    pairs = F.arrays_zip("low", "basis")
    add = lambda acc, p: F.zip_with(acc, p["basis"], lambda a, b: a + p["low"] * b)
    return shares.withColumn("rebuilt", F.aggregate(pairs, start, add)).drop("basis")
