"""Registered queries over runs, files and jobs. Orders and customers stand in for files and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiltmeter.functions import text as T
from tiltmeter.operators import catalog as C
from tiltmeter.plans import fixtures as X
from tiltmeter.plans.registry import query
from tiltmeter.plans.sql import with_tables
from tiltmeter.session import spread

_STEMS = """
stems AS (
  SELECT o_orderkey AS id,
    'Model-' || (o_custkey % 7) || '_' || CASE o_orderkey % 5 WHEN 0 THEN 'full_precision' WHEN 1 THEN 'rtn_w4' WHEN 2 THEN 'gptq_w4' WHEN 3 THEN 'awq_w4' ELSE 'awq_w8' END
    || CASE WHEN o_orderkey % 3 = 0 THEN '_logit_all' WHEN o_orderkey % 3 = 1 THEN '_cot_last' ELSE '' END
    || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '_' || (o_custkey % 3 + 1) END AS stem,
    'Model-' || (o_custkey % 7) AS model_id,
    CASE o_orderkey % 5 WHEN 0 THEN 'full_precision' WHEN 1 THEN 'rtn_w4' WHEN 2 THEN 'gptq_w4' WHEN 3 THEN 'awq_w4' ELSE 'awq_w8' END AS method_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'logit' WHEN o_orderkey % 3 = 1 THEN 'cot' END AS mode,
    CASE WHEN o_orderkey % 3 = 0 THEN 'all' WHEN o_orderkey % 3 = 1 THEN 'last' END AS layer_sel,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 3 + 1 END AS data_seed,
    CASE WHEN o_orderkey % 4 = 0 THEN 'pov' WHEN o_orderkey % 2 = 0 THEN 'plain' ELSE 'opinion_only' END AS condition
  FROM orders
)"""


def _stems(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    method = (
        F.when(k % 5 == 0, "full_precision").when(k % 5 == 1, "rtn_w4").when(k % 5 == 2, "gptq_w4").when(k % 5 == 3, "awq_w4").otherwise("awq_w8")
    )
    mode = F.when(k % 3 == 0, "_logit_all").when(k % 3 == 1, "_cot_last").otherwise("")
    seed = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("_"), (c % 3 + 1).cast("string")))
    condition = F.when(k % 4 == 0, "pov").when(k % 2 == 0, "plain").otherwise("opinion_only")
    model = F.concat(F.lit("Model-"), (c % 7).cast("string"))
    return spread(X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(
        k.alias("id"), F.concat(model, F.lit("_"), method, mode, seed).alias("stem"), condition.alias("condition")
    )


def _runs(spark, sf_dir):
    stems = _stems(spark, sf_dir)
    return stems.select("id", "stem", "condition", F.inline(F.array(C.parse_stem(F.col("stem")))))


@query(
    "run_catalog",
    with_tables(_STEMS)
    + """
SELECT id, 'exam' AS dataset, condition, CASE WHEN condition = 'pov' THEN 'prefix' END AS prefix_type,
       CASE WHEN condition = 'pov' THEN 'first_pov' END AS prefix_subtype, CASE WHEN condition = 'pov' THEN 'beginner' END AS level,
       model_id, method_id, CASE WHEN method_id LIKE '%w4' THEN 4 ELSE 8 END AS bits, mode, layer_sel, data_seed
FROM stems""",
)
def run_catalog(spark, sf_dir):
    """Paths taken apart into what used to be said by folder and file names."""
    folder = F.when(F.col("condition") == "pov", "pov/prefix/first_pov/beginner").otherwise(F.col("condition"))
    paths = _stems(spark, sf_dir).select(
        "id", F.concat(F.lit("/out/runs/exam/"), folder, F.lit("/"), F.col("stem"), F.lit(".parquet")).alias("path")
    )
    parsed = C.parse_path(paths, "/out/runs")
    return parsed.select(
        "id", "dataset", "condition", "prefix_type", "prefix_subtype", "level",
        F.inline(F.array(C.parse_stem(F.col("stem")))),
    )


@query(
    "stem_labels",
    with_tables(_STEMS)
    + """
SELECT id, replace(replace(regexp_replace(stem, '_[0-9]+$', ''), '_', '.'), '.Instruct', '-Instruct') AS bar_label,
       replace(replace(CASE WHEN mode IS NULL THEN stem ELSE model_id || '_' || method_id END, '_', ' '), '-', ' ') AS curve_label,
       CASE WHEN method_id LIKE 'full%' THEN method_id ELSE upper(split_part(method_id, '_', 1)) END AS axis_label,
       CASE WHEN method_id LIKE 'full%' THEN '8-bit' ELSE right(method_id, 1) || '-bit' END AS bit_label,
       model_id || '_' || method_id || CASE WHEN mode IS NULL THEN '' ELSE '_' || mode || '_' || layer_sel END AS run_key
FROM stems""",
)
def stem_labels(spark, sf_dir):
    method = F.regexp_replace("method_id", r"_w\d+\z", "")
    bits = F.concat(F.lit("w"), F.col("bits").cast("string"))
    return _runs(spark, sf_dir).select(
        "id",
        T.model_label(F.col("stem")).alias("bar_label"),
        T.curve_label(F.col("stem")).alias("curve_label"),
        T.series_label(method).alias("axis_label"),
        T.series_label(bits).alias("bit_label"),
        T.run_key(F.concat(F.col("stem"), F.lit(""))).alias("run_key"),
    )


@query(
    "stem_method_seed",
    with_tables(_STEMS)
    + """
SELECT id, CASE WHEN model_id = 'Model-3' THEN method_id || CASE WHEN mode IS NULL THEN '' ELSE '_' || mode || '_' || layer_sel END END AS method_id,
       CASE WHEN model_id = 'Model-3' THEN data_seed END AS data_seed,
       CASE WHEN stem LIKE '%\\_2' ESCAPE '\\' THEN stem ELSE stem || '_2' END AS seeded
FROM stems""",
)
def stem_method_seed(spark, sf_dir):
    split = T.split_method_and_seed(F.col("stem"), F.lit("Model-3"))
    return _stems(spark, sf_dir).select(
        "id",
        split["method_id"].alias("method_id"),
        split["data_seed"].alias("data_seed"),
        T.with_seed_suffix(F.col("stem"), F.lit(2)).alias("seeded"),
    )


@query(
    "run_pairs",
    with_tables(_STEMS)
    + """,
one AS (SELECT condition, model_id, method_id, data_seed, min(id) AS id FROM stems WHERE data_seed IS NOT NULL AND mode = 'logit' GROUP BY ALL),
pairs AS (SELECT p.model_id, p.method_id, p.data_seed, p.id AS id_plain, o.id AS id_opinion
          FROM one p JOIN one o USING (model_id, method_id, data_seed) WHERE p.condition = 'plain' AND o.condition = 'opinion_only')
SELECT q.model_id, q.method_id, q.data_seed, q.id_plain, q.id_opinion, f.id_opinion AS id_opinion_reference
FROM pairs q JOIN pairs f ON f.model_id = q.model_id AND f.data_seed = q.data_seed AND f.method_id = 'full_precision'
WHERE q.method_id <> 'full_precision'""",
)
def run_pairs(spark, sf_dir):
    """Plain and opinion runs by key, each quantised pair next to its full-precision run of the same seed."""
    runs = _runs(spark, sf_dir).where(F.col("data_seed").isNotNull() & (F.col("mode") == "logit"))
    keys = ["model_id", "method_id", "data_seed"]
    one = runs.groupBy("condition", *keys).agg(F.min("id").alias("id"))
    pairs = C.pair_conditions(one.where("condition = 'plain'"), one.where("condition = 'opinion_only'"), keys, "id")
    full = pairs.where("method_id = 'full_precision'")
    low = pairs.where("method_id <> 'full_precision'")
    return C.with_reference(low, full, ["model_id", "data_seed"], "id_opinion")


@query(
    "curve_series",
    with_tables(_STEMS)
    + """
SELECT label, list_sort(list(DISTINCT data_seed)) AS seeds FROM (
  SELECT upper(split_part(method_id, '_', 1)) AS label, data_seed FROM stems WHERE method_id LIKE '%w4' AND data_seed IS NOT NULL
) GROUP BY label""",
)
def curve_series(spark, sf_dir):
    """One curve per method at four bits, with its seeds in order."""
    runs = _runs(spark, sf_dir).where(F.col("data_seed").isNotNull())
    labelled = C.series(runs.where(F.endswith("method_id", F.lit("_w4"))), "method").select("label", "data_seed").distinct()
    return C.ordered_lists(labelled, ["label"], "data_seed", "data_seed").withColumnRenamed("data_seed", "seeds")


@query(
    "plottable_methods",
    with_tables(_STEMS)
    + """
SELECT DISTINCT method_id FROM stems p WHERE condition = 'plain' AND data_seed IN (1, 2)
  AND stem IN (SELECT stem FROM stems WHERE condition = 'opinion_only')""",
)
def plottable_methods(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return C.methods_with_both(runs.where("condition = 'plain'"), runs.where("condition = 'opinion_only'"), [1, 2])


@query(
    "first_run_file",
    with_tables(_STEMS)
    + "SELECT condition, min(stem) AS stem FROM stems WHERE data_seed = 2 AND lower(stem) LIKE '%awq%' GROUP BY condition",
)
def first_run_file(spark, sf_dir):
    return C.first_file(_stems(spark, sf_dir), ["condition"], "stem", seed=2, contains=" AWQ ")


@query(
    "pending_jobs",
    """
WITH jobs AS (SELECT c_custkey AS job, s.data_seed FROM customer, (SELECT unnest([1, 2, 3])::BIGINT AS data_seed) s),
done AS (SELECT DISTINCT o_custkey AS job, o_orderkey % 3 + 1 AS data_seed FROM orders WHERE o_orderstatus = 'F'),
ready AS (SELECT DISTINCT o_custkey AS job, o_orderkey % 3 + 1 AS data_seed FROM orders WHERE o_orderstatus <> 'F')
SELECT job, data_seed FROM jobs WHERE (job, data_seed) NOT IN (SELECT (job, data_seed) FROM done)
  AND (job, data_seed) IN (SELECT (job, data_seed) FROM ready)""",
)
def pending_jobs(spark, sf_dir):
    """Jobs times seeds, without those that have an output, of those that have an input."""
    jobs = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"))
    orders = X.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job"), (F.col("o_orderkey") % 3 + 1).alias("data_seed"), "o_orderstatus"
    )
    done = orders.where("o_orderstatus = 'F'")
    ready = orders.where("o_orderstatus <> 'F'")
    return C.pending_jobs(jobs, X.SEEDS, done, ["job"], ready)


@query(
    "missing_shards",
    """
SELECT s_suppkey AS shard FROM supplier WHERE s_suppkey % 10 <> 0 OR s_suppkey < 50
EXCEPT SELECT l_suppkey FROM lineitem WHERE l_linenumber > 3 AND l_suppkey % 7 <> 0""",
)
def missing_shards(spark, sf_dir):
    expected = X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shard")).where("shard % 10 <> 0 OR shard < 50")
    found = X.table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_suppkey").alias("shard"))
    return C.missing(expected, found.where("shard % 7 <> 0"))


@query(
    "module_prefixes",
    """
SELECT DISTINCT 'layers.' || (l_partkey % 40) || '.' || l_shipmode AS module FROM (
  SELECT l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'q_proj' WHEN 1 THEN 'k_proj' ELSE 'v_proj' END AS l_shipmode FROM lineitem WHERE l_returnflag = 'N')""",
)
def module_prefixes(spark, sf_dir):
    """Parameter names; only those with a buffer part count."""
    part = F.when(F.col("l_linenumber") % 3 == 0, "q_proj").when(F.col("l_linenumber") % 3 == 1, "k_proj").otherwise("v_proj")
    tail = F.when(F.col("l_returnflag") == "N", "buf_pitches").otherwise("weight")
    names = X.table(spark, sf_dir, "lineitem").select(
        F.concat_ws(".", F.lit("layers"), (F.col("l_partkey") % 40).cast("string"), part, tail).alias("name")
    )
    return C.module_prefixes(names)


_TAGS = (
    "CASE o_orderkey % 7 WHEN 0 THEN 'plain' WHEN 1 THEN 'opinion_only' WHEN 2 THEN 'authority_beginner' "
    "WHEN 3 THEN 'authority_advanced' WHEN 4 THEN 'logit_cot_plain' WHEN 5 THEN 'logit_cot_opinion' ELSE 'behavior_prefix' END"
)


@query(
    "wanted_jobs",
    f"""
SELECT tag, count(*) AS n FROM (SELECT {_TAGS} AS tag FROM orders)
WHERE tag IN ('plain', 'opinion_only') OR tag LIKE 'authority%' GROUP BY tag""",
)
def wanted_jobs(spark, sf_dir):
    jobs = X.table(spark, sf_dir, "orders").select(F.expr(_TAGS).alias("tag"))
    return C.wanted_tags(jobs, ["behavioral", "authority", "full_sr"]).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "known_bits_first",
    """
SELECT bits, row_number() OVER (ORDER BY bits NOT IN ('w4', 'w8'), bits)::INT AS place
FROM (SELECT DISTINCT 'w' || (p_size % 12) AS bits FROM part)""",
)
def known_bits_first(spark, sf_dir):
    bits = X.table(spark, sf_dir, "part").select(
        T.normalise_bits(F.concat(F.lit(" "), (F.col("p_size") % 12).cast("string"))).alias("bits")
    ).distinct()
    # A handful of distinct bit widths is left; their order is kept as a column.
    listed = C.known_first(bits, "bits", ["w4", "w8"]).agg(
        F.array_sort(F.collect_list(F.struct(~F.col("bits").isin("w4", "w8"), "bits"))).alias("l")
    )
    return listed.select(F.posexplode("l").alias("i", "b")).select("b.bits", (F.col("i") + 1).alias("place"))


@query("path_labels", "SELECT page_id, replace(replace(url, '/', '_'), chr(92), '_') AS label FROM pages")
def path_labels(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.path_safe(F.col("url")).alias("label"))


@query(
    "dataset_slugs",
    """
SELECT c_custkey, CASE WHEN s = '_raw' THEN 'dataset' ELSE regexp_replace(s, '_raw$', '') END AS slug FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '_raw' WHEN c_custkey % 3 = 1 THEN c_name || '_raw' ELSE c_name END AS s FROM customer)""",
)
def dataset_slugs(spark, sf_dir):
    k = F.col("c_custkey") % 3
    s = F.when(k == 0, "_raw").when(k == 1, F.concat("c_name", F.lit("_raw"))).otherwise(F.col("c_name"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", T.dataset_slug(s).alias("slug"))
