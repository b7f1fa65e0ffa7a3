"""Triangular factors of many matrices at once, by tile rows.

A matrix is cut into tile rows of ``tile`` consecutive rows. Step k finishes tile row k of every matrix and sends it to
the tile rows below, which take it out of their own: one equi-join by matrix per step. A task holds two tile rows at a
time, never a matrix, and all matrices advance together, however many there are.

With the columns in reverse order, the inverse of the lower Cholesky factor is, reversed back, the upper Cholesky factor
of the inverse: U = J L⁻¹ J for J H J = L Lᵀ. So the inverse itself is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiltmeter.session import settle

TILE = 256


def column_orders(hessian: DataFrame, damping: float, by_diagonal: bool, keys: Sequence[str]) -> DataFrame:
    """keys…, order, dead, damp: per matrix the columns in the order of treatment, those without any activation, and
    what is added to the diagonal. As wide as one row of the matrix.
    """
    diagonal = hessian.select(*keys, "i", F.element_at("h", F.col("i") + 1).alias("d"))
    diagonal = diagonal.withColumn("dead", F.col("d") == 0).withColumn("d", F.when(F.col("dead"), 1.0).otherwise(F.col("d")))
    place = -F.col("d") if by_diagonal else F.lit(0.0)
    packed = diagonal.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "i"))).alias("_by"),
        F.array_sort(F.collect_list(F.when(F.col("dead"), F.col("i")))).alias("dead"),
        (damping * F.avg("d")).alias("damp"),
    )
    return packed.select(*keys, F.transform("_by", lambda b: b["i"]).alias("order"), "dead", "damp")


def by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join by matrix, NULL being a key like any other; without keys all is one matrix."""
    names = list(keys) or ["_one"]
    if not keys:
        left, right = left.withColumn("_one", F.lit(0)), right.withColumn("_one", F.lit(0))
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    same = None
    for name in names:
        equal = F.col(name).eqNullSafe(F.col(f"_r_{name}"))
        same = equal if same is None else same & equal
    return left.join(renamed, same).drop(*[f"_r_{name}" for name in names], "_one")


def tile_rows(hessian: DataFrame, orders: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """keys…, t, width, a: the damped matrix in reverse order of treatment, ``tile`` rows a record (doubles, row by row)."""
    rows = by_keys(hessian, orders, keys)
    backwards, width = F.reverse("order"), F.size("order")
    column = F.col("i")
    value = lambda j: F.when((j == column) & F.array_contains("dead", column), 1.0).otherwise(F.element_at("h", j + 1))
    damped = F.transform(backwards, lambda j: value(j) + F.when(j == column, F.col("damp")).otherwise(0.0))
    rows = rows.select(*keys, (width - F.array_position("order", column)).cast("int").alias("place"), width.alias("width"), damped.alias("h"))
    t = F.floor(F.col("place") / tile).cast("int")
    packed = rows.groupBy(*keys, t.alias("t")).agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("place", "h"))).alias("_rows"))
    return packed.select(*keys, "t", "width", F.transform("_rows", lambda r: r["h"]).alias("rows"))


def _schema(df: DataFrame, keys: Sequence[str], *names: str) -> T.StructType:
    kinds = {"t": T.IntegerType(), "width": T.IntegerType()}
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return T.StructType(fields + [T.StructField(n, kinds.get(n, T.BinaryType())) for n in names])


def _doubles(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, width)


def inverse_rows(tiles: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """keys…, t, width, x: the tile rows of L⁻¹, for the tile rows of a symmetric positive definite matrix.

    The state of a tile row is what is known of its part of L and the right side that will become its part of L⁻¹.
    """
    keys = list(keys)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, right = [], []
            for t, width, rows in zip(pdf["t"], pdf["width"], pdf["rows"]):
                own.append(np.stack([np.asarray(r, dtype=np.float64) for r in rows]).tobytes())
                right.append(np.eye(width)[t * tile : (t + 1) * tile].tobytes())
            yield pdf[[*keys, "t", "width"]].assign(a=own, x=right)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lower, solved = [], []
            for t, width, a, x in zip(pdf["t"], pdf["width"], pdf["a"], pdf["x"]):
                own, at = _doubles(a, width).copy(), t * tile
                before, end = own[:, :at], at + len(own)
                corner = np.linalg.cholesky(own[:, at:end] - before @ before.T)
                own[:, at:end], own[:, end:] = corner, 0.0
                lower.append(own.tobytes())
                solved.append(np.linalg.solve(corner, _doubles(x, width)).tobytes())
            yield pdf[keys].assign(p_l=lower, p_x=solved)

    def eliminate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, right = [], []
            for width, a, x, p_l, p_x, at in zip(pdf["width"], pdf["a"], pdf["x"], pdf["p_l"], pdf["p_x"], pdf["at"]):
                part, pivot = _doubles(a, width).copy(), _doubles(p_l, width)
                end = at + len(pivot)
                rest = part[:, at:end] - part[:, :at] @ pivot[:, :at].T
                part[:, at:end] = np.linalg.solve(pivot[:, at:end], rest.T).T
                own.append(part.tobytes())
                right.append((_doubles(x, width) - part[:, at:end] @ _doubles(p_x, width)).tobytes())
            yield pdf[[*keys, "t", "width"]].assign(a=own, x=right)

    state = settle(tiles.mapInPandas(start, _schema(tiles, keys, "t", "width", "a", "x")))
    done = None
    for k in range((state.agg(F.max("t")).first()[0] or 0) + 1):
        pivots = state.where(F.col("t") == k)
        pivots = settle(pivots.mapInPandas(finish, _schema(state, keys, "p_l", "p_x")))
        solved = by_keys(state.where(F.col("t") == k).select(*keys, "t", "width"), pivots.select(*keys, F.col("p_x").alias("x")), keys)
        done = solved if done is None else done.unionByName(solved)
        below = by_keys(state.where(F.col("t") > k), pivots, keys).withColumn("at", F.lit(k * tile))
        state = settle(below.mapInPandas(eliminate, _schema(state, keys, "t", "width", "a", "x")))
    return done


def inverse_factors(hessian: DataFrame, damping: float = 0.01, by_diagonal: bool = False, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys…, i (place in the order), column, dead, h ARRAY: the upper Cholesky factor of the damped inverse per matrix.

    ``hessian`` holds keys…, i, h. ``damping`` times the mean of the diagonal is added to it. Columns without any
    activation get a one on the diagonal and are ``dead``. Columns are treated as they come or, ``by_diagonal``, the
    largest first, equal ones as they come.
    """
    keys = list(keys)
    orders = settle(column_orders(hessian, damping, by_diagonal, keys))
    found = by_keys(inverse_rows(tile_rows(hessian, orders, keys, tile), keys, tile), orders, keys)
    fields = [T.StructField(k, hessian.schema[k].dataType) for k in keys]
    fields += [T.StructField("i", T.IntegerType()), T.StructField("column", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("dead", T.BooleanType()), T.StructField("h", T.ArrayType(T.DoubleType()))])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(len(pdf)):
                record = pdf.iloc[at : at + 1]
                t, width, order, dead = (record[c].iloc[0] for c in ("t", "width", "order", "dead"))
                # Reversed back: the last row of L⁻¹ is the first of the factor.
                part = _doubles(record["x"].iloc[0], width)[:, ::-1]
                places = width - 1 - np.arange(t * tile, t * tile + len(part))
                columns = np.asarray(order)[places].astype("int32")
                out = pd.DataFrame({k: [record[k].iloc[0]] * len(part) for k in keys}, index=range(len(part)))
                yield out.assign(i=places.astype("int32"), column=columns, dead=np.isin(columns, dead), h=list(part))

    return found.select(*keys, "t", "width", "x", "order", "dead").mapInPandas(rows, schema)
