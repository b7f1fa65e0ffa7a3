"""Compression methods by name: each turns weight rows (and activations) into fake-quantised weight rows."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions.quantmath import IntFormat
from tiltmeter.operators import gram as G
from tiltmeter.operators import quantize as Q
from tiltmeter.operators import ranges as N
from tiltmeter.operators.factors import inverse_factors
from tiltmeter.operators.ordered import attach

# Bit widths tried when a method is named without one, and the width of an id without a suffix (fixed values).
DEFAULT_BITS = (4, 6, 8)
BITS_WITHOUT_SUFFIX = 8

Run = Callable[[DataFrame, DataFrame, IntFormat, int], DataFrame]


@dataclass(frozen=True)
class Method:
    name: str
    run: Run

    def method_id(self, bits: int) -> str:
        return f"{self.name}_w{bits}"


METHODS: dict[str, Method] = {}


def method(name: str):
    """Register a rule under a name; a name can be taken once."""

    def register(run: Run) -> Run:
        if name in METHODS:
            raise ValueError(f"method {name} exists already")
        METHODS[name] = Method(name, run)
        return run

    return register


def bits_of(method_id: str) -> int | None:
    found = re.search(r"_w(\d+)\Z", method_id.strip())
    return int(found.group(1)) if found else None


def expand(entries: Sequence[Mapping[str, str]]) -> list[tuple[str, str, int]]:
    """(name, id, bits) per run: an id brings its bits, a bare name is tried at every default width."""
    runs: list[tuple[str, str, int]] = []
    for entry in entries:
        known = METHODS.get(entry.get("method", ""))
        if known is None:
            continue
        given = entry.get("method_id")
        ids = [given] if given else [known.method_id(b) for b in DEFAULT_BITS]
        runs += [(known.name, i, bits_of(i) or BITS_WITHOUT_SUFFIX) for i in ids]
    return runs


def draw_seeds(master: int, n: int) -> list[int]:
    """n different data seeds below 2**31, always the same for a master seed."""
    if n < 1:
        raise ValueError("at least one seed is needed")
    source = random.Random(master)
    seeds: dict[int, None] = {}
    while len(seeds) < n:
        seeds.setdefault(source.randrange(2**31))
    return list(seeds)


def is_left_out(entries: Sequence[str], block: str = "block", layer: str = "layer") -> Column:
    """Whether a row belongs to a layer left out: by block number, by a range of them (``a-b``) or by layer name."""
    out = F.lit(False)
    for entry in (e.strip() for e in entries):
        span = re.fullmatch(r"(\d+)(?:-(\d+))?", entry)
        if span:
            out = out | F.col(block).between(int(span[1]), int(span[2] or span[1]))
        else:
            out = out | (F.col(layer) == entry)
    return F.coalesce(out, F.lit(False))


def quantise_weights(method_id: str, weights: DataFrame, activations: DataFrame, group: int, left_out: Sequence[str] = ()) -> DataFrame:
    """row_id, w after the method. ``activations`` has batch and x.

    Layers in ``left_out`` (see :func:`is_left_out`) keep their weights and take no part in any search.
    """
    name = re.sub(r"_w\d+\Z", "", method_id)
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known are {sorted(METHODS)}")
    fmt = IntFormat(bits_of(method_id) or BITS_WITHOUT_SUFFIX)
    if not left_out:
        return METHODS[name].run(weights, activations, fmt, group)
    exact = is_left_out(left_out)
    changed = METHODS[name].run(weights.where(~exact), activations, fmt, group)
    return changed.unionByName(weights.where(exact).select("row_id", "w"))


def joined_groups(rows: DataFrame, values: str = "snapped") -> DataFrame:
    """Groups of a row back to one array. A row has as many groups as its width allows."""
    packed = rows.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("group", values))).alias("_g"))
    return packed.select("row_id", F.flatten(f"_g.{values}").alias("w"))


@method("full_precision")
def _unchanged(weights, activations, fmt, group):
    return weights.select("row_id", "w")


@method("rtn")
def _round_to_nearest(weights, activations, fmt, group):
    return Q.round_rows(weights, fmt, group=group).select("row_id", F.col("snapped").alias("w"))


@method("gptq")
def _error_feedback(weights, activations, fmt, group):
    factor = inverse_factors(G.pitched_hessian(activations, "batch"))
    return G.error_feedback(weights, factor, fmt, group).select("row_id", F.col("snapped").alias("w"))


@method("awq")
def _activation_pitched(weights, activations, fmt, group):
    """Widen or narrow columns, quantise, undo it."""
    best = G.best_pitch(weights.select("row_id", "w"), activations, "batch", fmt, group).select("s")
    pitches = attach(weights, best)
    widened = pitches.select("row_id", "s", F.zip_with("w", "s", lambda w, s: w * s).alias("w"))
    rows = Q.round_rows(widened, fmt, group=group)
    return rows.select("row_id", F.zip_with("snapped", "s", lambda q, s: q / s).alias("w"))


@method("hqq")
def _proximal(weights, activations, fmt, group):
    rows = N.proximal_zeros(Q.quantise(weights, fmt, group=group), fmt, ["row_id", "group"])
    pitch, zero = F.col("pitch"), F.col("zero")
    # The searched zero point is not an integer, so rounding takes it in.
    loose = IntFormat(fmt.bits, fmt.symmetric, round_zero=False)
    return joined_groups(rows.withColumn("snapped", F.transform("v", lambda x: loose.snap(x, pitch, zero))))


@method("llmint8")
def _outliers_exact(weights, activations, fmt, group, threshold: float = 6.0):
    """Columns whose activations reach the threshold stay exact, the others are quantised per row."""
    exact = (
        Q.outlier_columns(activations, threshold)
        .where("is_outlier")
        .agg(F.array_sort(F.collect_list("pos")).alias("exact"))
    )
    rows = attach(Q.quantise(weights, fmt), exact)
    return rows.select("row_id", Q.keep_columns(F.col("snapped"), F.col("v"), F.col("exact")).alias("w"))


@method("adadim")
def _better_direction(weights, activations, fmt, group):
    """Ranges along rows or columns, whichever changes the layer output less."""
    chosen = G.better_direction(weights.select("row_id", "w"), activations, fmt).select("direction")
    along_rows = Q.quantise(weights, fmt).select("row_id", F.col("snapped").alias("_oc"))
    along_columns = Q.quantise_input_columns(weights, fmt).select("row_id", F.col("snapped").alias("_ic"))
    both = attach(along_rows.join(along_columns, "row_id"), chosen)
    return both.select("row_id", F.when(F.col("direction") == "ic", F.col("_ic")).otherwise(F.col("_oc")).alias("w"))
