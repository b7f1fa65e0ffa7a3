from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tiltmeter import schemas
from tiltmeter.operators import catalog as C
from tiltmeter.operators import layers as L
from tiltmeter.operators import ordered as O
from tiltmeter.operators import prune as U
from tiltmeter.operators import questions as Q
from tiltmeter.operators import rates as R
from tiltmeter.operators import samplers as S
from tiltmeter.operators import stats as T
from tiltmeter.operators import trajectories as J
from tiltmeter.plans import fixtures
from tiltmeter.plans.registry import load_all


# --- order -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows are one group, and half of that one value."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        group = "hot" if i % 2 else f"g{i % 7}"
        value = 0.5 if i % 4 == 1 else rng.gauss(0, 1)
        rows.append((i, group, value))
    return rows, spark.createDataFrame(rows, "i long, g string, v double").repartition(6)


def test_kth_smallest_with_a_hot_value(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in O.kth_smallest(df, ["g"], "v", F.ceil(F.col("n") * 0.6)).collect()}
    for g in {r[1] for r in rows}:
        values = sorted(v for _, h, v in rows if h == g)
        k = -(-len(values) * 6 // 10)
        assert got[g]["threshold"] == values[k - 1] and got[g]["n"] == len(values)
    everything = sorted(v for *_, v in rows)
    assert O.kth_smallest(df, [], "v", F.lit(1234)).first()["threshold"] == everything[1233]


def test_numbering_and_running_values(skewed):
    rows, df = skewed
    numbered = O.number_within(df, ["g"], [F.col("i")], O.id_bucket(df, "i")).collect()
    for g in {r[1] for r in rows}:
        assert [r["number"] for r in sorted((r for r in numbered if r["g"] == g), key=lambda r: r["i"])] == list(
            range(sum(r[1] == g for r in rows))
        )
    running = O.running(
        df, [], [F.col("i")], O.id_bucket(df, "i"), {"lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "n": ("sum", F.lit(1))}
    ).orderBy("i").collect()
    lo = hi = None
    for n, (r, (_, _, v)) in enumerate(zip(running, rows), 1):
        lo, hi = (v, v) if lo is None else (min(lo, v), max(hi, v))
        assert (r["lo"], r["hi"], r["n"]) == (lo, hi, n)


def test_medians(skewed):
    rows, df = skewed
    got = {r["g"]: r["median"] for r in T.medians(df, ["g"], "v").collect()}
    for g in got:
        assert got[g] == pytest.approx(statistics.median(v for _, h, v in rows if h == g))


def test_buckets_only_balance(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert O.value_cuts(df.limit(0), "v") == []
    few = [100.0, 100.5, 900.0]
    got = df.groupBy(O.value_bucket(F.col("v"), few).alias("b")).count().orderBy("b").collect()
    assert [(r["b"], r["count"]) for r in got] == [(0, 100), (1, 1), (2, 799), (3, 100)]


# --- rates -----------------------------------------------------------------------------------

def answers(spark, rows):
    schema = "question_id long, method_id string, data_seed long, condition string, correct_answer_index string, chosen_wrong_answer_index string, model_answer string"
    return spark.createDataFrame(rows, schema)


def test_rates_use_valid_answers_only(spark):
    rows = [(i, "m", 1, "opinion_only", "A", "B", a) for i, a in enumerate(["A", "B", "C", "", "Error", None, "a", "AB"])]
    got = R.rate_triple(answers(spark, rows)).first()
    assert (got["accuracy"], got["opinion_rate"], got["error_rate"]) == pytest.approx((1 / 3, 1 / 3, 1 / 3))
    counts = R.guarded_rates(answers(spark, [(1, "m", 1, "plain", "A", None, "")]), ["method_id"]).first()
    assert (counts["n_total"], counts["n_valid"], counts["correct_rate"]) == (1, 0, 0.0)
    assert R.rate_triple(answers(spark, [(1, "m", 1, "plain", "A", None, "")])).count() == 0


def test_accuracy_controlled_counts_every_opinion_row_once(spark):
    rows = []
    for m in ("full_precision", "low"):
        for q, known in ((1, True), (2, m == "low"), (3, True)):
            # The same question asked twice: once right is enough to know it.
            rows += [(q, m, 1, "plain", "A", None, "A" if known else "C"), (q, m, 1, "plain", "A", None, "D")]
            rows += [(q, m, 1, "opinion_only", "A", "B", "B" if q == 1 else "A")] * 2
    rows.append((3, "low", 1, "opinion_only", "A", "B", "Error"))
    got = {r["method_id"]: r for r in R.accuracy_controlled_rates(answers(spark, rows)).collect()}
    assert got["low"]["n_shared"] == 2 and got["low"]["n_valid"] == 4
    assert (got["low"]["accuracy"], got["low"]["opinion_rate"], got["low"]["error_rate"]) == (0.5, 0.5, 0.0)


def test_question_key_cascade(spark):
    df = spark.createDataFrame([(1, "t")], "row_idx long, question string")
    assert df.select(schemas.question_key(df).alias("k")).first()["k"] == "t"
    assert df.select(schemas.question_key(df.drop("question")).alias("k")).first()["k"] == "1".join(["__idx__", ""])


# --- questions -------------------------------------------------------------------------------

def test_missing_columns_and_empty_tables_are_refused(spark):
    df = spark.createDataFrame([("q", "s")], "question string, subject string")
    with pytest.raises(schemas.MissingColumns, match="choices"):
        Q.clean_questions(df)
    with pytest.raises(schemas.EmptyTable):
        schemas.require_rows(df.limit(0))


def test_a_single_option_has_no_other(spark):
    df = spark.createDataFrame([(1, "q", "s", ["only"], 0)], "question_id long, question string, category string, options array<string>, answer_index int")
    got = Q.opinion_library(df, 1).first()
    assert got["chosen_wrong_answer_index"] == "N/A" and got["full_question"].endswith("I believe the answer is N/A. something else.")


def test_wrong_option_is_never_the_right_one_and_differs_by_condition(spark, sf_dir):
    questions = fixtures.mcq(spark, sf_dir).withColumnsRenamed(Q.RAW_NAMES)
    picks = {}
    for condition in ("opinion_only", "beginner"):
        rows = Q.opinion_library(questions, 42, condition).collect()
        assert all(r["chosen_wrong_answer_index"] != r["correct_answer_index"] for r in rows)
        picks[condition] = [r["chosen_wrong_answer_index"] for r in sorted(rows, key=lambda r: r["question_id"])]
    assert picks["opinion_only"] != picks["beginner"]
    assert len(set(picks["beginner"])) >= 4


def test_choice_structs_of_arrays(spark):
    df = spark.sql("select named_struct('label', array(' b', 'A'), 'text', array('two', 'one')) c, named_struct('label', array('A'), 'text', array('one', 'two')) bad")
    got = df.select(
        Q.choice_pairs(F.col("c"), df.schema["c"].dataType).alias("c"), Q.choice_pairs(F.col("bad"), df.schema["bad"].dataType).alias("bad")
    ).first()
    assert [p["text"] for p in got["c"]] == ["one", "two"] and got["bad"] is None


# --- layers ----------------------------------------------------------------------------------

def paths(spark, letters, correct="A", wrong="B"):
    strength = {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4}
    layers = [(i, [3.0 if j == strength[c] else 0.0 for j in range(5)]) for i, c in enumerate(letters)]
    return J.trajectories(
        spark.createDataFrame(
            [(1, correct, wrong, layers)],
            "question_id long, correct_answer_index string, chosen_wrong_answer_index string, layers array<struct<layer:int,logits:array<double>>>",
        )
    )


@pytest.mark.parametrize(
    "letters, changes, stable",
    [("AAAA", 0, 0), ("BAAA", 1, 1), ("AABAA", 2, None), ("BBB", 0, 0), ("AB", 1, None), ("CABBBAAA", 3, 5), ("EEEE", 0, 0)],
)
def test_stabilisation(spark, letters, changes, stable):
    got = paths(spark, letters).first()
    assert (got["prediction_changes"], got["stabilisation_layer"], got["final_prediction"]) == (changes, stable, letters[-1])


def test_emergence_keeps_layer_zero(spark):
    got = J.emergence(paths(spark, "BBBAB")).first()
    assert (got["first_opinion_match"], got["first_opinion_stable"], got["first_opinion_pair"], got["first_correct_match"]) == (0, 0, 0, 3)
    assert got["opinion_dominance"] == pytest.approx(0.8)
    none = J.emergence(paths(spark, "AAC")).first()
    assert none["first_opinion_match"] is None and none["confidence_at_match"] is None


def test_pairs_keep_shared_layers_only(spark):
    schema = "question_id long, layers array<struct<layer:int,logits:array<double>>>"
    a = spark.createDataFrame([(1, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)])], schema)
    b = spark.createDataFrame([(1, [(1, [2.0, 2.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])])], schema)
    pairs = L.pair_runs(a, b)
    assert [p["layer"] for p in pairs.first()["pairs"]] == [1, 2]
    assert [r["layer"] for r in L.kl_curve(pairs).collect()] == [1]


def test_own_letters_are_preferred(spark):
    plain = spark.createDataFrame([(1, " c ")], "question_id long, chosen_wrong_answer_index string")
    assert L.with_suggested_letter(plain, plain).first()["suggested"] == "C"


# --- tests -----------------------------------------------------------------------------------

def test_small_samples_are_exact(spark):
    rows = [("x", False, 1.0), ("x", False, 2.0), ("x", True, 3.0), ("x", True, 4.0), ("x", True, 5.0)]
    df = spark.createDataFrame(rows, "t string, second boolean, v double")
    got = T.mann_whitney(df, ["t"], "v", F.col("second"), exact=True).first()
    assert got["u"] == 0.0 and got["p_value"] == pytest.approx(0.2)
    assert T.mann_whitney(df, ["t"], "v", F.col("second")).first()["p_value"] == pytest.approx(0.149, abs=1e-3)


def test_rank_test_of_millions_of_equal_values(spark):
    n = 3_000_000
    counts = spark.createDataFrame([("x", 1.0, n, n // 2), ("x", 2.0, n // 2, n)], "t string, v double, n1 long, n2 long")
    got = T.rank_test(counts, ["t"], "v").first()
    assert got["u"] == 0.75 * n * n and got["p_value"] < 1e-9


def test_rank_test_with_one_hot_value(spark):
    rng = random.Random(2)
    rows = [("x", i % 2 == 0, 1.0 if i % 3 == 0 else rng.gauss(0.3 * (i % 2), 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "t string, second boolean, v double")
    got = T.mann_whitney(df, ["t"], "v", F.col("second")).first()
    a, b = [v for _, s, v in rows if not s], [v for _, s, v in rows if s]
    assert got["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


# --- samples and jobs ------------------------------------------------------------------------

def test_windows_cross_texts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "WINDOW_BLOCK", 8)
    texts = [" ".join(f"w{d}_{i}" for i in range(d % 9)) for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    words = " ".join(texts).split()
    got = S.random_windows(docs, 25, 20, 3).collect()
    assert len(got) == 25
    for r in got:
        start = words.index(r["tokens"][0])
        assert r["tokens"] == words[start : start + 20]
    blocks = {r["block"]: r["tokens"] for r in S.corpus_blocks(docs, 16).collect()}
    assert blocks == {b: words[b * 16 : b * 16 + 16] for b in range(len(words) // 16)}


def test_ids_with_wide_gaps(spark):
    texts = {i * 10_000_019 - 5 * 10**9: f"t{i} u{i}" for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    placed = {r["doc_id"]: r["offset"] for r in S.placed_documents(docs).collect()}
    assert placed == {k: 2 * i for i, k in enumerate(sorted(texts))}
    for ids in ([*range(4000), 10**18], [i * 100_000 for i in range(4000)]):
        df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
        sizes = [r["count"] for r in df.groupBy(O.id_bucket(df, "doc_id").alias("b")).count().collect()]
        assert max(sizes) < 4 * len(ids) / O.FEW_BUCKETS and len(sizes) > O.FEW_BUCKETS / 2


def test_a_hot_conversation_is_cut_where_it_should_be(spark):
    turns = [(1, t, "user", "word " * 5) for t in range(500)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r["conv_id"]: r["tokens"] for r in S.chat_texts(df, 5, 30, 1).collect()}
    assert len(got[1]) == 30 and got[1][:2] == ["<|im_start|>user", "word"]
    assert got[2] == ["<|im_start|>user", "hi", "<|im_end|>"]


def test_batches_and_ranks(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert [r["i"] for r in S.strided(df, 1, 4, "i").orderBy("i").collect()] == [1, 5, 9]
    assert {r["batch"] for r in S.batches(df, -1, "i").collect()} == {0}
    assert [r["batch"] for r in S.batches(df, 4, "i").orderBy("i").collect()] == [0] * 4 + [1] * 4 + [2] * 2


def test_tags():
    assert C.expand_tags(["behavioral", "correct_only", ""]) == {"plain", "opinion_only"}
    with pytest.raises(ValueError, match="unknown tag"):
        C.expand_tags(["nonsense"])


def test_pruned_share(spark):
    df = spark.createDataFrame([(i, [float(i * 10 + j) - 50 for j in range(10)]) for i in range(10)], "row_id long, w array<double>")
    pruned = U.magnitude_prune(df, 0.25).agg(F.sum("pruned").alias("n")).first()["n"]
    assert pruned in (26, 27)  # the value at place 25 goes too, and so does its twin of the other sign
    assert U.unchanged(df) is df


def test_queries_read_what_they_are_given(spark, sf_dir):
    """No query is built on literals alone."""
    for name in ("rate_at_volume", "run_catalog", "custom_samples"):
        plan = load_all()[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan


def test_windows_leave_the_texts_where_they_are(spark):
    """No text is moved: below the gathering of parts there is neither an exchange nor a broadcast of it."""
    docs = spark.createDataFrame([(i, f"a{i} b c d e f g") for i in range(200)], "doc_id long, text string").repartition(4)
    for out in (S.random_windows(docs, 8, 16, 3), S.document_windows(docs, 8, 4, 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin [doc_id" not in plan
        side = "BuildRight" if "BuildRight" in plan else "BuildLeft"
        assert side in plan and out.count() == 8
