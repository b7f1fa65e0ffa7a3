from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltmeter.functions import answers as A
from tiltmeter.functions import prob as P
from tiltmeter.functions import text as X
from tiltmeter.functions.significance import chi_square_p, two_sided_p
from tiltmeter.functions.vectors import cosine, kurtosis
from tiltmeter.operators.stats import exact_tail



def abcd():
    return F.array(*[F.lit(c) for c in "ABCD"])



def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(
        f"{n} {'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}"
        for n, v in values.items()
    )
    df = spark.createDataFrame([tuple(values[n] for n in names)], schema)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('["a", "b"]', ["a", "b"]),
        ("['a', 'b']", ["a", "b"]),
        ("['it\\'s', \"x, y\"]", ["it's", "x, y"]),
        ("['tab\\there', 'caf\\u00e9', '\\x41']", ["tab\there", "café", "A"]),
        ("[1, -2.5, True, None]", ["1", "-2.5", "True", None]),
        ("[]", []),
        (" [ 'a' , ] ", ["a"]),
        ("not a list", None),
        ("('a', 'b')", None),
        ("{'a': 1}", None),
        ("['a' 'b'", None),
        ("__import__('os')", None),
        (None, None),
    ],
)
def test_list_literal(spark, text, expected):
    assert one(spark, X.parse_list_literal(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("{B}", "B"),
        ("{Z} then B", "B"),
        ("{Z} then {A}", "A"),
        ("Answer: C.", "C"),
        ("aBc", ""),
        ("AB C", "C"),
        ("A,B", "A"),
        ("E or D", "D"),
        ("A\n", "A"),
        ("", ""),
        ("   ", ""),
        (None, ""),
    ],
)
def test_extract_letter(spark, raw, expected):
    assert one(spark, A.extract_letter(F.col("t"), abcd()), t=raw) == expected


@pytest.mark.parametrize(
    "answer, strict, wide",
    [("A", True, True), ("Z", True, True), ("A\n", True, False), ("A\n\n", False, False), ("\n", False, False), ("[", False, False), ("Ä", False, True), ("a", False, False), ("AB", False, False), ("", False, False), ("Error", False, False), (None, False, False)],
)
def test_validity(spark, answer, strict, wide):
    assert one(spark, A.is_valid(F.col("t")), t=answer) is strict
    assert one(spark, A.is_valid_any_script(F.col("t")), t=answer) is wide


@pytest.mark.parametrize("text", ["  a b \n", "\t\x0b\x1c x\xa0 ", "", " \n ", "plain", "a  \n  b"])
def test_strip_like_python(spark, text):
    assert one(spark, X.strip(F.col("t")), t=text) == text.strip()
    assert one(spark, X.lstrip(F.col("t")), t=text) == text.lstrip()


def test_option_letters(spark):
    prompt = "Which?\nA. one\nB. two\nC. three\nAnswer:"
    assert one(spark, A.option_letters(F.col("t")), t=prompt) == ["A", "B", "C"]
    assert one(spark, A.option_positions(F.col("t")), t=prompt) == [prompt.index(f"{c}. ") for c in "ABC"]
    skipped = "Which?\nA. one\nC. three\nB. two\nI believe the answer is C. three."
    assert one(spark, A.option_letters(F.col("t")), t=skipped) == ["A", "B"]
    assert one(spark, A.option_letters(F.col("t")), t="no options here") == list("ABCD")
    assert one(spark, A.option_positions(F.col("t")), t="A. only one") == []


def test_core_question_takes_the_plain_tail_first(spark):
    text = "q\nI believe the answer is A. x.\nAnswer: y"
    assert one(spark, X.core_question(F.col("t")), t=text) == "q\nI believe the answer is A. x."


def test_softmax_and_kl(spark):
    a, b = [1.0, 2.0, 3.0, -1.0], [0.5, 2.5, 1.0, 0.0]

    def soft(v):
        e = np.exp(np.array(v) - max(v))
        return e / (e.sum() + 1e-10)

    p, q = soft(a) + 1e-10, soft(b) + 1e-10
    got = one(spark, P.kl_divergence(P.softmax(F.col("a")), P.softmax(F.col("b"))), a=a, b=b)
    assert got == pytest.approx(float((p * np.log(p / q)).sum()), abs=1e-12)
    assert one(spark, P.kl_divergence(P.softmax(F.col("a")), P.softmax(F.col("a"))), a=a) == 0.0
    assert one(spark, P.kl_divergence(F.col("a"), F.col("b")), a=a, b=b[:3]) is None
    huge = one(spark, P.softmax(F.col("a")), a=[1e12, -1e12, float("-inf")])
    assert huge == pytest.approx([1.0, 0.0, 0.0])


def test_ordered_logits_need_every_letter(spark):
    row = spark.sql(
        "select map('B', 2D, 'A', 1D) ok, map('A', 1D, 'C', 2D) gap, map('A', 1D) short, map('A', 1D, 'B', 2D, 'x', 9D) extra"
    )
    got = row.select(*[P.ordered_logits(F.col(c)).alias(c) for c in row.columns]).first()
    assert got["ok"] == [1.0, 2.0] and got["extra"] == [1.0, 2.0]
    assert got["gap"] is None and got["short"] is None


def test_decision_score(spark):
    values = [1.0, 5.0, 3.0]
    for i, c in enumerate("ABC"):
        assert one(spark, P.decision_score(F.col("v"), F.lit(c)), v=values) == pytest.approx((values[i] - 1) / 4, abs=1e-9)
    assert one(spark, P.decision_score(F.col("v"), F.lit("D")), v=values) is None
    assert one(spark, P.decision_score(F.col("v"), F.lit("A")), v=[2.0, 2.0]) == 0.0


def test_first_letter_wins_a_tie(spark):
    assert one(spark, P.top_letter(F.col("v")), v=[1.0, 3.0, 3.0]) == "B"
    assert [s["pos"] for s in one(spark, P.top_k(F.col("v"), 2), v=[3.0, 1.0, 3.0])] == [0, 2]


def test_answer_probabilities(spark):
    inf = float("-inf")
    assert one(spark, P.answer_probabilities(F.col("v")), v=[inf, inf]) == [0.5, 0.5]
    assert one(spark, P.answer_probabilities(F.col("v")), v=[inf, 800.0, 800.0]) == [0.0, 0.5, 0.5]


@pytest.mark.parametrize("z", [0.0, 1e-6, 0.1, 0.7, 1.3, 1.99, 2.0, 2.5, 4.0, 8.0, 20.0])
def test_normal_tail(spark, z):
    expected = math.erfc(z / math.sqrt(2))
    assert one(spark, two_sided_p(F.col("z")), z=z) == pytest.approx(expected, rel=1e-9, abs=1e-300)
    assert one(spark, chi_square_p(F.col("z")), z=z * z) == pytest.approx(expected, rel=1e-9, abs=1e-300)


def test_exact_rank_test_counts_orderings():
    from itertools import combinations

    for n1, n2 in [(1, 4), (3, 3), (2, 5), (4, 3)]:
        n = n1 + n2
        us = [sum(1 for i in first for j in set(range(n)) - set(first) if i > j) for first in combinations(range(n), n1)]
        for u in range(n1 * n2 + 1):
            if u * 2 < n1 * n2:
                continue
            expected = min(1.0, 2 * sum(x >= u for x in us) / len(us))
            assert exact_tail(n1, n2, u) == pytest.approx(expected)


def test_vectors(spark):
    assert math.isnan(one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]))
    rng = random.Random(1)
    v = [rng.gauss(0, 1) for _ in range(50)]
    a = np.array(v)
    expected = (((a - a.mean()) / a.std(ddof=1)) ** 4).mean()
    assert one(spark, kurtosis(F.col("v")), v=v) == pytest.approx(expected)


@pytest.mark.parametrize(
    "stem, key",
    [
        ("M-1B_rtn_w4_logit_all_42", "M-1B_rtn_w4_logit_all"),
        ("M_plain_all_20240101_120000", "M"),
        ("M_opinion_only_all", "M"),
        ("M_20240101_120000", "M"),
    ],
)
def test_run_key_drops_seeds(spark, stem, key):
    assert one(spark, X.run_key(F.col("t")), t=stem) == key


def test_labels(spark):
    assert one(spark, X.model_label(F.col("t")), t="Llama-3.2-1B_Instruct_20240101_1200") == "Llama-3.2-1B-Instruct"
    assert one(spark, X.series_label(F.col("t")), t="w4") == "4-bit"
    assert one(spark, X.series_label(F.col("t")), t="gptq") == "GPTQ"
    assert one(spark, X.normalise_bits(F.col("t")), t=" 4 ") == "w4"
    assert one(spark, X.bits_of_method(F.col("t")), t="full_precision") == 8
