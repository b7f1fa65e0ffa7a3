"""Per-layer curves: decision scores and divergences between prompt conditions and between precisions.

Tables hold one row per question with ``layers`` ARRAY<STRUCT<layer, logits>>, the logits in letter
order. A join therefore moves one row per question, and everything within a layer stays in the array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions import prob as P
from tiltmeter.functions.answers import tidy_letter
from tiltmeter.operators.ordered import attach, id_bucket, number_within, running_total


def layer_number(name: Column) -> Column:
    """``layer_12`` -> 12, NULL if there is no number in second place."""
    return F.get(F.split(name, "_", -1), F.lit(1)).try_cast("int")


def layers_from_maps(df: DataFrame, column: str = "layer_logits") -> DataFrame:
    """Nested map -> ``layers`` array sorted by layer.

    Layers with an unreadable name are dropped. ``logits`` is NULL where the letters have a gap; ``low``
    and ``high`` span every value of the layer.
    """

    def one(entry: Column) -> Column:
        values = F.map_values(entry["value"])
        return F.struct(
            layer_number(entry["key"]).alias("layer"),
            P.ordered_logits(entry["value"]).alias("logits"),
            F.array_min(values).alias("low"),
            F.array_max(values).alias("high"),
        )

    entries = F.filter(F.transform(F.map_entries(column), one), lambda s: s["layer"].isNotNull())
    return df.where(F.col(column).isNotNull()).withColumn("layers", F.array_sort(entries)).drop(column)


def in_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Keep layers first..last, both included."""
    return df.withColumn("layers", F.filter("layers", lambda s: s["layer"].between(first, last)))


def chosen_layers(which: str, layers: str = "layers") -> Column:
    """``all``, ``odd``, ``even`` (both always with the last layer) or ``last`` of an array of layers."""
    rules = {
        "": lambda layer, last: F.lit(True),
        "all": lambda layer, last: F.lit(True),
        "odd": lambda layer, last: (layer % 2 == 1) | (layer == last),
        "even": lambda layer, last: (layer % 2 == 0) | (layer == last),
        "last": lambda layer, last: layer == last,
    }
    if which not in rules:
        raise ValueError(f"unknown layer choice {which!r}; expected one of {sorted(rules)}")

    def choose(run: Column) -> Column:
        return F.filter(run["layers"], lambda s: rules[which](s["layer"], run["last"]))

    # The last layer is bound once per row, not once per layer.
    run = F.struct(F.col(layers).alias("layers"), F.array_max(f"{layers}.layer").alias("last"))
    return F.get(F.transform(F.array(run), choose), F.lit(0))


def layer_subset(df: DataFrame, which: str) -> DataFrame:
    """Keep a choice of the layers."""
    return df.withColumn("layers", chosen_layers(which))


# --- alignment -------------------------------------------------------------------------------

def pair_runs(left: DataFrame, right: DataFrame, on: Sequence[str] = ("question_id",), keep: Sequence[str] = ()) -> DataFrame:
    """Inner join of two runs on question (and seed): per layer in both, struct(layer, left, right)."""
    on = list(on)
    l = left.select(*on, *keep, F.col("layers").alias("_l"))
    r = right.select(*on, F.col("layers").alias("_r"))

    def zipped(a: Column, b: Column) -> Column:
        return F.zip_with(
            a,
            b,
            lambda x, y: F.struct(x["layer"].alias("layer"), x["logits"].alias("left"), y["logits"].alias("right")),
        )

    def matched(a: Column, b: Column) -> Column:
        shared = F.filter(a, lambda x: F.exists(b, lambda y: y["layer"] == x["layer"]))
        return F.transform(
            shared,
            lambda x: F.struct(
                x["layer"].alias("layer"),
                x["logits"].alias("left"),
                F.get(F.filter(b, lambda y: y["layer"] == x["layer"]), F.lit(0))["logits"].alias("right"),
            ),
        )

    same = F.col("_l.layer") == F.col("_r.layer")
    both = F.when(same, zipped(F.col("_l"), F.col("_r"))).otherwise(matched(F.col("_l"), F.col("_r")))
    return l.join(r, on).select(*on, *keep, both.alias("pairs"))


def align(left: DataFrame, right: DataFrame, on: str, index: str, suffixes=("_plain", "_opinion")) -> DataFrame:
    """Inner join on a shared key; every other column gets a suffix, rows get a running ``uid`` from 0.

    ``uid`` follows the left index, then the right one. A left row meets all right rows of its key, so its
    first number is the running total of match counts and the rest is the right row's place in its key:
    both are worked out on the inputs, and the joined rows are never sorted.
    """
    here, there = index + suffixes[0], index + suffixes[1]
    a = left.select(F.col(on), *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c != on])
    b = right.select(F.col(on), *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c != on])
    matches = b.groupBy(on).agg(F.count(F.lit(1)).alias("_matches"))
    starts = running_total(
        a.join(matches, on), [], [F.col(here)], F.col("_matches"), id_bucket(a, here), "_start"
    ).drop("_matches")
    placed = number_within(b, [on], [F.col(there)], id_bucket(b, there), "_place")
    joined = starts.join(placed, on)
    return joined.withColumn("uid", F.col("_start") + F.col("_place")).drop("_start", "_place")


def misaligned_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], text: str) -> DataFrame:
    """Pairs of two runs at the same place whose question differs: on…, left, right. Empty if the runs fit together."""
    l = left.select(*on, F.col(text).alias("left"))
    r = right.select(*on, F.col(text).alias("right"))
    return l.join(r, list(on)).where(~F.col("left").eqNullSafe(F.col("right")))


def first_per_key(df: DataFrame, key: str, index: str) -> DataFrame:
    """The row with the smallest index of every key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.col(index)).alias("_first")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def suggested_letters(opinion: DataFrame, on: Sequence[str] = ("question_id",), index: str = "question_id") -> DataFrame:
    """First usable suggested letter per question key."""
    tidy = opinion.withColumn("_letter", tidy_letter(F.col("chosen_wrong_answer_index"))).where(
        F.col("_letter").isNotNull()
    )
    return tidy.groupBy(*on).agg(F.min_by("_letter", F.col(index)).alias("suggested"))


def with_suggested_letter(
    plain: DataFrame, opinion: DataFrame, on: Sequence[str] = ("question_id",), index: str = "question_id"
) -> DataFrame:
    """Attach the suggested letter to plain rows: their own column if it holds any value, else the opinion prompt's."""
    own = "chosen_wrong_answer_index"
    looked_up = plain.join(suggested_letters(opinion, on, index), list(on), "left")
    if own not in plain.columns:
        return looked_up
    any_own = plain.agg(F.coalesce(F.bool_or(F.col(own).isNotNull()), F.lit(False)).alias("_any_own"))
    letter = F.when(F.col("_any_own"), tidy_letter(F.col(own))).otherwise(F.col("suggested"))
    return attach(looked_up, any_own).withColumn("suggested", letter).drop("_any_own")


# --- curves ----------------------------------------------------------------------------------

def kl_curve(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean KL(left ‖ right) per layer; pairs with different or missing options do not count."""
    exploded = pairs.select(*keys, F.inline("pairs")).where(F.size("left") == F.size("right"))
    shares = exploded.select(
        *keys, "layer", P.softmax(F.col("left")).alias("p"), P.softmax(F.col("right")).alias("q")
    )
    values = shares.select(*keys, "layer", P.kl_divergence(F.col("p"), F.col("q")).alias("kl"))
    clean = F.nanvl(F.col("kl"), F.lit(None).cast("double"))
    return values.groupBy(*keys, "layer").agg(F.avg(clean).alias("kl"), F.count(clean).alias("n"))


def mean_over_seeds(curves: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Second-level mean per layer, NaN left out."""
    clean = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return curves.groupBy(*keys, "layer").agg(F.avg(clean).alias(value), F.count(clean).alias("n_seeds"))


def decision_scores(df: DataFrame, letter_columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per question and layer with a score per letter column; NULL where the letter is not offered."""
    rows = df.select(*keys, *letter_columns.values(), F.explode("layers").alias("s"))
    spans = {f.name for f in rows.schema["s"].dataType.fields}
    low = F.col("s.low") if "low" in spans else None
    high = F.col("s.high") if "high" in spans else None
    logits = F.col("s.logits")
    scores = [
        P.decision_score(logits, tidy_letter(F.col(letter)), low, high).alias(name)
        for name, letter in letter_columns.items()
    ]
    return rows.where(logits.isNotNull()).select(*keys, F.col("s.layer").alias("layer"), *scores)


def score_curve(scores: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean score per layer over all rows of all seeds."""
    return scores.groupBy(*keys, "layer").agg(
        *[F.avg(n).alias(n) for n in names], F.count(names[0]).alias("n")
    )
