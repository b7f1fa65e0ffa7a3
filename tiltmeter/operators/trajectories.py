"""How the favoured answer moves from layer to layer. One row per question; no window, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions import prob as P

STABLE_RUN = 3


def first_run_start(hits: Column, layers: Column, run: int) -> Column:
    """Layer at which ``run`` hits in a row begin for the first time; NULL if they never do."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(hits) - run),
        lambda i: F.forall(F.slice(hits, i + 1, F.lit(run)), lambda h: h),
    )
    return F.when(F.size(hits) >= run, F.get(layers, F.get(starts, F.lit(0))))


def trajectories(df: DataFrame, suggested: bool = True) -> DataFrame:
    """Add per-question arrays ``path_layers``, ``predictions``, ``confidences`` and what follows from them."""
    ordered = F.array_sort(F.filter("layers", lambda s: s["logits"].isNotNull()))
    steps = F.transform(
        ordered,
        lambda s: F.struct(
            s["layer"].alias("layer"),
            P.top_letter(s["logits"]).alias("prediction"),
            F.array_max(P.softmax(s["logits"], 0.0)).alias("confidence"),
        ),
    )
    base = df.where(F.exists("layers", lambda s: s["logits"].isNotNull())).withColumn("steps", steps)
    base = base.withColumns(
        {
            "path_layers": F.col("steps.layer"),
            "predictions": F.col("steps.prediction"),
            "confidences": F.col("steps.confidence"),
            "final_prediction": F.element_at("steps.prediction", -1),
            "final_confidence": F.element_at("steps.confidence", -1),
        }
    ).drop("steps")
    moves = F.zip_with(
        F.slice("predictions", F.lit(2), F.size("predictions")),
        F.slice("predictions", F.lit(1), F.size("predictions") - 1),
        lambda a, b: a != b,
    )
    settled = F.transform("predictions", lambda p: p == F.col("final_prediction"))
    found = {
        "prediction_changes": F.size(F.filter(moves, lambda m: m)),
        "stabilisation_layer": first_run_start(settled, F.col("path_layers"), STABLE_RUN),
        "is_correct": F.col("final_prediction") == F.col("correct_answer_index"),
    }
    if suggested and "chosen_wrong_answer_index" in df.columns:
        found["follows_opinion"] = F.col("final_prediction") == F.col("chosen_wrong_answer_index")
    return base.withColumns(found)


def emergence(paths: DataFrame) -> DataFrame:
    """When and how firmly the suggested answer takes over, per question with a suggested letter."""
    opinion, right = F.col("chosen_wrong_answer_index"), F.col("correct_answer_index")
    hits = F.transform("predictions", lambda p: p == opinion)
    rights = F.transform("predictions", lambda p: p == right)

    def first_hit(flags: Column, values: Column) -> Column:
        return F.get(values, (F.array_position(flags, F.lit(True)) - 1).cast("int"))

    def mean_where(flags: Column) -> Column:
        chosen = F.filter(F.zip_with(flags, F.col("confidences"), lambda h, c: F.when(h, c)), lambda c: c.isNotNull())
        return F.when(F.size(chosen) > 0, P.total(chosen) / F.size(chosen))

    layers = F.col("path_layers")
    marked = paths.where(opinion.isNotNull()).withColumns({"_hits": hits, "_rights": rights})
    any_hit, any_right = F.array_contains("_hits", True), F.array_contains("_rights", True)
    return marked.withColumns(
        {
            "first_opinion_match": F.when(any_hit, first_hit(F.col("_hits"), layers)),
            "confidence_at_match": F.when(any_hit, first_hit(F.col("_hits"), F.col("confidences"))),
            "first_opinion_stable": first_run_start(F.col("_hits"), layers, STABLE_RUN),
            "first_opinion_pair": first_run_start(F.col("_hits"), layers, 2),
            "first_correct_match": F.when((right != opinion) & any_right, first_hit(F.col("_rights"), layers)),
            "opinion_dominance": F.size(F.filter("_hits", lambda h: h)) / F.size("_hits"),
            "opinion_confidence": mean_where(F.col("_hits")),
            "correct_confidence": mean_where(F.col("_rights")),
        }
    ).drop("_hits", "_rights")


def opinion_rate_by_position(paths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of questions whose n-th layer favours the suggested letter."""
    rows = paths.where(F.col("chosen_wrong_answer_index").isNotNull()).select(
        *keys, "chosen_wrong_answer_index", F.posexplode("predictions").alias("position", "prediction")
    )
    hit = (F.col("prediction") == F.col("chosen_wrong_answer_index")).cast("double")
    return rows.groupBy(*keys, "position").agg(F.avg(hit).alias("opinion_rate"), F.count(F.lit(1)).alias("n"))


def consistency(paths: DataFrame, key: str = "question_id") -> DataFrame:
    """One row per question and layer: does the layer already favour the final answer?"""
    flags = F.transform("predictions", lambda p: p == F.col("final_prediction"))
    pairs = F.arrays_zip(F.col("path_layers").alias("layer"), flags.alias("consistent"))
    return paths.select(key, F.inline(pairs).alias("layer", "consistent"))


def confidence_by_layer(df: DataFrame, keys: Sequence[str] = (), last_layer: int | None = None) -> DataFrame:
    """Mean probability of the right and of the misleading option per layer."""
    suggested = (
        F.col("chosen_wrong_answer_index") if "chosen_wrong_answer_index" in df.columns else F.lit(None).cast("string")
    )
    rows = df.where(F.col("correct_answer_index").isNotNull()).select(
        *keys, "correct_answer_index", suggested.alias("suggested"), F.inline("layers")
    )
    if last_layer is not None:
        rows = rows.where(F.col("layer") <= last_layer)
    probs = rows.where(F.col("logits").isNotNull()).withColumn("p", P.softmax(F.col("logits"), 0.0))
    right = F.coalesce(F.get("p", P.letter_index(F.col("correct_answer_index"))), F.lit(0.0))
    wrong = P.misleading_confidence(F.col("p"), F.col("correct_answer_index"), F.col("suggested"))
    return probs.groupBy(*keys, "layer").agg(
        F.avg(right).alias("correct_confidence"),
        F.avg(wrong).alias("misleading_confidence"),
        F.count(F.lit(1)).alias("n"),
    )
