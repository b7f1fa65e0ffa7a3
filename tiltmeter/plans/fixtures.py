"""Evaluation tables derived from the given tables by fixed rules, the same in Spark and in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.functions.hashing import portable_hash
from tiltmeter.functions.text import letter_at
from tiltmeter.session import spread

METHODS = ("full_precision", "rtn_w4", "gptq_w4", "awq_w4", "awq_w8")
SEEDS = (1, 2, 3)
LEVELS = ("beginner", "intermediate", "advanced")
CONDITIONS = ("plain", "opinion_only", *LEVELS)
LAYERS = 16
LETTERS = 4
GROUP = 16
FRAME = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, subject, choices, answer."""
    part = table(spark, sf_dir, "part")
    n = F.when(F.col("p_partkey") % 3 == 0, 5).otherwise(4)
    return part.select(
        F.col("p_partkey").alias("question_id"),
        F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("question"),
        F.col("p_type").alias("subject"),
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.concat(F.col("p_brand"), F.lit("-"), ((F.col("p_size") + 7 * i) % 50).cast("string")),
        ).alias("choices"),
        (F.col("p_partkey") % n).cast("int").alias("answer"),
    )


def responses(spark: SparkSession, sf_dir: str, methods=METHODS, seeds=SEEDS, conditions=CONDITIONS) -> DataFrame:
    """One answer per question, method, seed and condition."""
    part = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id")))
    n = F.when(F.col("question_id") % 3 == 0, 5).otherwise(4)
    # Hashes are worked out inside the arrays that are exploded, so that no filter on an answer repeats them.
    question = F.col("question_id")

    def ask(seed: Column, condition: Column) -> Column:
        h = portable_hash(question, seed, condition, "w")
        return F.struct(seed.alias("data_seed"), condition.alias("condition"), h.alias("hw"))

    asked = [ask(F.lit(s).cast("bigint"), F.lit(c)) for s in seeds for c in conditions]
    drawn = [
        F.struct(
            F.lit(m).alias("method_id"),
            (portable_hash(question, F.lit(m), F.col("data_seed"), F.col("condition"), "a") % 100).alias("b"),
        )
        for m in methods
    ]
    b = F.col("b")
    suggested = letter_at(F.col("wrong"))
    return (
        part.select("question_id", F.inline(F.array(*asked)))
        .withColumn("n", n)
        .withColumn("ans", (F.col("question_id") % F.col("n")).cast("int"))
        .withColumn("wrong", ((F.col("ans") + 1 + F.col("hw") % (F.col("n") - 1)) % F.col("n")).cast("int"))
        .select("*", F.inline(F.array(*drawn)))
        .select(
            "question_id",
            "method_id",
            "data_seed",
            "condition",
            letter_at(F.col("ans")).alias("correct_answer_index"),
            F.when(F.col("condition") != "plain", suggested).alias("chosen_wrong_answer_index"),
            F.when(b < 3, "")
            .when(b < 5, "Error")
            .when(b < 6, F.lit(None))
            .when(b < 7, "Ä")
            .when(b < 50, letter_at(F.col("ans")))
            .when(
                b < 80,
                F.when(F.col("condition") != "plain", suggested).otherwise(
                    letter_at((F.col("ans") + 1) % F.col("n"))
                ),
            )
            .otherwise(letter_at((b % F.col("n")).cast("int")))
            .alias("model_answer"),
        )
    )


def layer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question: right and suggested letter, and per layer the logits of the plain and opinion prompt.

    ``layers`` is ARRAY<STRUCT<layer, plain, opinion>> with the logits in letter order.
    """
    base = spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("question_id"),
        F.col("embedding").cast("array<double>").alias("v"),
        (F.col("label") % 4).alias("right"),
        ((F.col("label") % 4 + 1 + F.col("vec_id") % 3) % 4).cast("int").alias("wrong"),
    )

    def layer(i: Column) -> Column:
        plain = F.transform(F.slice(F.col("v"), i * LETTERS + 1, F.lit(LETTERS)), lambda x: 10 * x)
        pushed = F.transform(
            plain, lambda x, j: F.when((j == F.col("wrong")) & (i >= 8), x + F.lit(3.0)).otherwise(x)
        )
        return F.struct(i.alias("layer"), plain.alias("plain"), pushed.alias("opinion"))

    return base.select(
        "question_id",
        letter_at(F.col("right")).alias("correct_answer_index"),
        letter_at(F.col("wrong")).alias("chosen_wrong_answer_index"),
        # Exploding an array of one keeps the layers from being worked out again wherever they are used.
        F.explode(F.array(F.transform(F.sequence(F.lit(0), F.lit(LAYERS - 1)), layer))).alias("layers"),
    )


def layer_table(spark: SparkSession, sf_dir: str, condition: str, quantised: bool = False) -> DataFrame:
    """One condition as its own table: question_id, letters, layers ARRAY<STRUCT<layer, logits>>."""
    runs = layer_runs(spark, sf_dir)

    def keep(s: Column) -> Column:
        logits = s[condition]
        if quantised:
            logits = F.transform(logits, lambda x: F.rint(4 * x) / 4)
        return F.struct(s["layer"].alias("layer"), logits.alias("logits"))

    columns = ["question_id", "correct_answer_index"]
    if condition != "plain":
        columns.append("chosen_wrong_answer_index")
    return runs.select(*columns, F.transform("layers", keep).alias("layers"))


def raw_layer_maps(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    """The same logits as a raw nested map, with the defects real files have.

    Every 11th question misses letter B in layer 3; every 13th has an unreadable name for layer 5.
    """
    runs = layer_runs(spark, sf_dir)
    key = F.col("question_id")

    def named(s: Column) -> Column:
        return F.when((key % 13 == 0) & (s["layer"] == 5), F.lit("layer_x")).otherwise(
            F.concat(F.lit("layer_"), s["layer"].cast("string"))
        )

    def by_letter(s: Column) -> Column:
        entries = F.transform(s[condition], lambda v, i: F.struct(letter_at(i).alias("key"), v.alias("value")))
        broken = (key % 11 == 0) & (s["layer"] == 3)
        return F.map_from_entries(F.filter(entries, lambda e: ~(broken & (e["key"] == "B"))))

    maps = F.map_from_arrays(F.transform("layers", named), F.transform("layers", by_letter))
    columns = ["question_id", "correct_answer_index"]
    if condition != "plain":
        columns.append("chosen_wrong_answer_index")
    return runs.select(*columns, maps.alias("layer_logits"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, label, w ARRAY<DOUBLE>."""
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("w")
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
