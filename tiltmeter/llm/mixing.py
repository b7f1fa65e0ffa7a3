"""Mixing sources to target weights: repetition rates from token counts per source, copies by hash-seeded draws.

Everything is DataFrame expressions. Documents are added up per source before any shuffle, so a source with a third of
all rows costs no more than another; the one-row-per-source table is then ranked, filled up to its caps and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltmeter.llm.common import text_column, word_count, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Independent draws per document. Each source takes the one whose total comes nearest to its target.
SEEDS = 32


def draw(id_col: Column, seed: Column) -> Column:
    """Number in [0, 2**32) from the id: the seed's eight hexadecimal digits of an md5."""
    text = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), F.floor(seed / 4).cast("string"))
    return F.conv(F.substring(F.md5(text), 8 * (seed % 4) + 1, F.lit(8)), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in order of code points, NULL last, take the weights in turn and share the total of all sizes. No target
    exceeds ``most`` times its source; what is over goes to the others by weight. The shares that this ends in are
    those of one level: target = least(weight * level, cap). Sources are ordered by the level at which they fill up;
    the level is the first that leaves all later ones below their caps.
    """
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", pick).drop("rank")
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy(F.col("full_at"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"),
    )
    level = (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before"))
    filled = filled.withColumn("level", level).withColumn("full", F.col("level") > F.col("full_at"))
    open_level = F.min(F.when(~F.col("full"), F.struct("full_at", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * open_level)
    return filled.select("source", "source_size", "weight", target.alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what is known of their source; NULL meets NULL."""
    sources = sources.withColumnRenamed("source", "__source")
    return rows.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def copies_per_document(
    docs: DataFrame,
    weights=WEIGHTS,
    most: int = MOST_REPEATS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keyed: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    The rate of a source is its target over its size. A document is taken floor(rate) times and once more with the
    probability of the rest, drawn from a hash of its id. Rows that repeat an id share a draw; a NULL id draws as the
    empty one. NULL or blank text has size 0 and is still drawn. NULL is a source of its own. A source of size 0 has
    target 0 and is not taken. Other columns are not read. ``keyed`` adds ``text_key``, a hash of source and text that
    tells rows that repeat an id apart.
    """
    rows = docs.select(
        *([text_key(text_col, source_col).alias("text_key")] if keyed else []),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_column(docs, text_col)).alias("size"),
    )
    rows = written(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn("whole", F.floor("rate"))
    rated = rated.withColumn("part", F.col("rate") - F.col("whole"))

    drawn = _with_source(rows, rated)
    extra = [F.sum(F.when(draw(F.col("doc_id"), F.lit(s)) < F.col("part") * 2.0**32, F.col("size")).otherwise(0)) for s in range(SEEDS)]
    totals = drawn.groupBy("source").agg(*[e.alias(f"extra{s}") for s, e in enumerate(extra)])
    # The words that the source still wants after its whole copies; the nearest draw wins, the lowest seed on a tie.
    wanted = F.col("part") * F.col("source_size")
    gaps = F.array(*[F.struct(F.abs(F.col(f"extra{s}") - wanted).alias("gap"), F.lit(s).alias("seed")) for s in range(SEEDS)])
    seeded = _with_source(totals, rated).select("source", "source_size", "target", "whole", "part", F.array_min(gaps)["seed"].alias("seed"))
    final = _with_source(rows, seeded)
    chosen = draw(F.col("doc_id"), F.col("seed")) < F.col("part") * 2.0**32
    copies = (F.col("whole") + chosen.cast("long")).cast("long")
    return final.withColumn("copies", copies).select(
        *([F.col("text_key")] if keyed else []),
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def text_key(text_col: str, source_col: str) -> Column:
    return F.xxhash64(F.col(source_col), F.col(text_col))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every input row as many times as it is taken, with all its columns; rows not taken are left out.

    Cases are those of ``copies_per_document``. Rows that are equal in id, source and text are taken alike.
    """
    taken = copies_per_document(docs, weights, most, id_col, text_col, source_col, keyed=True)
    taken = taken.where("copies > 0").select("doc_id", "text_key", "copies").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"), text_key(text_col, source_col).alias("row_key"))
    rows = rows.join(taken, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("text_key")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
