"""Runs, files and jobs as tables: reading what names say, pairing runs, and finding what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.functions import text as X

# Tags an alias stands for, the other tags there are, and those that only steer figures (fixed values).
TAG_ALIASES: dict[str, tuple[str, ...]] = {
    "behavioral": ("plain", "opinion_only"),
    "mechanistic": ("logit_cot_plain", "logit_cot_opinion"),
    "logit_cot": ("logit_cot_plain", "logit_cot_opinion"),
}
JOB_TAGS = ("plain", "opinion_only", "authority", "behavior_prefix", "logit_cot_plain", "logit_cot_opinion")
FIGURE_TAGS = ("correct_only", "full_sr")
LEVEL_TAG = "authority"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """Files matching a pattern, below folders too; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", "length")
    )


def stem(path: Column) -> Column:
    """Last path part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)\z", 1), r"\.[^.]*\z", "")


def parse_path(paths: DataFrame, base: str, path: str = "path") -> DataFrame:
    """``base/dataset/condition[/prefix_type/prefix_subtype/level]/stem.ext`` -> one column per part."""
    parts = F.split(F.substring_index(F.col(path), base.rstrip("/") + "/", -1), "/", -1)
    deep = F.size(parts) >= 6
    return paths.withColumn("_parts", parts).select(
        *paths.columns,
        F.get("_parts", F.lit(0)).alias("dataset"),
        F.get("_parts", F.lit(1)).alias("condition"),
        F.when(deep, F.get("_parts", F.lit(2))).alias("prefix_type"),
        F.when(deep, F.get("_parts", F.lit(3))).alias("prefix_subtype"),
        F.when(deep, F.get("_parts", F.lit(4))).alias("level"),
        stem(F.col(path)).alias("stem"),
    )


_RUN = r"\A(.+?)_(full_precision|[A-Za-z0-9]+_w\d+)(?:_(logit|cot)_([a-z]+))?(?:_(\d+))?\z"


def parse_stem(stem: Column) -> Column:
    """``model_method[_mode_layers][_seed]`` -> struct; all NULL for a stem of another form.

    The pattern is matched once; a mark that no name holds takes the parts apart.
    """
    mark = "\x1f"
    split = F.split(F.regexp_replace(stem, _RUN, mark.join(f"${i}" for i in range(1, 6))), mark, -1)

    def named(parts: Column) -> Column:
        whole = F.size(parts) == 5

        def part(i: int) -> Column:
            return F.when(whole, F.nullif(F.get(parts, F.lit(i)), F.lit("")))

        return F.struct(
            part(0).alias("model_id"),
            part(1).alias("method_id"),
            F.when(whole, X.bits_of_method(F.get(parts, F.lit(1)))).alias("bits"),
            part(2).alias("mode"),
            part(3).alias("layer_sel"),
            part(4).try_cast("bigint").alias("data_seed"),
        )

    # Going through an array of one binds the parts, so they are taken apart once for all fields.
    return F.get(F.transform(F.array(split), named), F.lit(0))


def pair_conditions(plain: DataFrame, opinion: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs that exist under both conditions, by run key."""
    left = plain.select(*keys, F.col(value).alias(f"{value}_plain"))
    right = opinion.select(*keys, F.col(value).alias(f"{value}_opinion"))
    return left.join(right, list(keys))


def with_reference(quantised: DataFrame, reference: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quantised runs next to the full-precision run of the same seed; runs without one are left out."""
    return quantised.join(reference.select(*keys, F.col(value).alias(f"{value}_reference")), list(keys))


def series(runs: DataFrame, by: str) -> DataFrame:
    """Label runs for one curve each: ``by`` is ``bits``, ``method`` or ``single``."""
    method = F.regexp_extract("method_id", r"\A(.+)_w\d+\z", 1)
    bit = F.regexp_extract("method_id", r"_(w\d+)\z", 1)
    label = {
        "bits": bit,
        "method": X.series_label(method),
        "single": F.concat(F.upper(method), F.lit(" "), bit),
    }[by]
    order = F.lower(method) if by == "method" else label
    return runs.where(bit != "").withColumn("label", label).withColumn("sort_key", order)


def ordered_lists(rows: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Per key the values in order of seed. A run has a handful of seeds."""
    pair = F.struct(F.col(order).alias("_order"), F.col(value).alias("_value"))
    packed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(pair)).alias("_p"))
    return packed.select(*key, F.col("_p._value").alias(value))


def first_file(rows: DataFrame, keys: Sequence[str], name: str, seed: int | None = None, contains: str | None = None) -> DataFrame:
    """First file by name per folder, among those with the seed suffix and the text in their name."""
    kept = rows
    if seed is not None:
        kept = kept.where(F.endswith(name, F.lit(f"_{seed}")))
    if contains and contains.strip():
        kept = kept.where(F.contains(F.lower(name), F.lit(contains.strip().lower())))
    return kept.groupBy(*keys).agg(F.min(name).alias(name))


def known_first(rows: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Known values first, then by value."""
    return rows.orderBy(~F.col(column).isin(*known), column)


def pending_jobs(
    jobs: DataFrame, seeds: Sequence[int], done: DataFrame, key: Sequence[str], ready: DataFrame | None = None
) -> DataFrame:
    """Every job with every seed that has no output yet and, if ``ready`` is given, whose input is there."""
    todo = jobs.withColumn("data_seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
    todo = todo.join(done.select(*key, "data_seed"), [*key, "data_seed"], "left_anti")
    return todo if ready is None else todo.join(ready.select(*key, "data_seed"), [*key, "data_seed"], "left_semi")


def methods_with_both(plain: DataFrame, opinion: DataFrame, seeds: Sequence[int] | None = None, name: str = "stem") -> DataFrame:
    """Methods with a file of the same name under both conditions, sorted."""
    kept = plain if seeds is None else plain.where(F.col("data_seed").isin(*seeds))
    both = kept.join(opinion.select(name), name, "left_semi")
    return both.select("method_id").where(F.col("method_id") != "").distinct().orderBy("method_id")


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct expected rows that were not found; columns are matched by position."""
    return expected.subtract(found)


def module_prefixes(names: DataFrame, name: str = "name", marker: str = "buf_") -> DataFrame:
    """Distinct module paths that have a parameter part starting with the marker."""
    parts = F.split(F.col(name), r"\.", -1)
    at = F.array_position(F.transform(parts, lambda p: F.startswith(p, F.lit(marker))), F.lit(True))
    found = names.select(parts.alias("_parts"), at.alias("_at")).where(F.col("_at") > 0)
    head = F.slice("_parts", F.lit(1), (F.col("_at") - 1).cast("int"))
    return found.select(F.array_join(head, ".").alias("module")).distinct()


def expand_tags(tokens: Sequence[str]) -> set[str]:
    """Names as given on a command line -> job tags; figure tags are dropped, unknown ones refused."""
    tags: set[str] = set()
    for token in (t.strip() for t in tokens):
        if token in TAG_ALIASES:
            tags.update(TAG_ALIASES[token])
        elif token in JOB_TAGS:
            tags.add(token)
        elif token and token not in FIGURE_TAGS:
            raise ValueError(f"unknown tag {token!r}")
    return tags


def wanted_tags(jobs: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Jobs whose tag was asked for; the level tag admits every level."""
    tags = expand_tags(tokens)
    keep = F.col("tag").isin(*sorted(tags)) if tags else F.lit(False)
    if LEVEL_TAG in tags:
        keep = keep | F.startswith("tag", F.lit(LEVEL_TAG + "_"))
    return jobs.where(keep)
