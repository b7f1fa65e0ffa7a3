"""Probabilities over option letters. Logits are ARRAY<DOUBLE> in letter order, starting at A."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards against log(0) and division by 0 (fixed values).
SOFTMAX_EPS = 1e-10
KL_EPS = 1e-10
SCORE_EPS = 1e-9
LOGIT_CLIP = 1e10


def letter_index(letter: Column) -> Column:
    """A -> 0, B -> 1, ..."""
    return F.ascii(letter) - 65


def ordered_logits(by_letter: Column) -> Column:
    """MAP<letter, logit> -> ARRAY in letter order; NULL unless the letters run A, B, … without a gap."""
    letters = F.array_sort(F.filter(F.map_keys(by_letter), lambda k: F.regexp_like(k, F.lit(r"\A[A-Z]\z"))))
    unbroken = F.forall(
        F.transform(letters, lambda c, i: F.ascii(c) - 65 == i), lambda ok: ok
    )
    return F.when(
        (F.size(letters) >= 2) & unbroken, F.transform(letters, lambda c: by_letter[c].cast("double"))
    )


def softmax(logits: Column, eps: float = SOFTMAX_EPS) -> Column:
    """Softmax with clipping and the largest logit taken off; ``eps`` is added to the denominator."""
    clipped = F.transform(logits, lambda v: F.greatest(F.lit(-LOGIT_CLIP), F.least(F.lit(LOGIT_CLIP), v)))
    top = F.least(F.lit(LOGIT_CLIP), F.greatest(F.lit(-LOGIT_CLIP), F.array_max(logits)))
    weights = F.transform(clipped, lambda v: F.exp(v - top))
    start = F.struct(weights.alias("w"), F.aggregate(weights, F.lit(0.0), lambda a, v: a + v).alias("total"))
    # One struct per row keeps the total from being recomputed for every element.
    return F.get(
        F.transform(F.array(start), lambda s: F.transform(s["w"], lambda v: v / (s["total"] + F.lit(eps)))),
        F.lit(0),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def kl_divergence(p: Column, q: Column, eps: float = KL_EPS) -> Column:
    """KL(p ‖ q) in nats; NULL when either side is missing or their supports differ."""
    terms = F.zip_with(
        p,
        q,
        lambda a, b: (a + F.lit(eps)) * (F.ln(a + F.lit(eps)) - F.ln(b + F.lit(eps))),
    )
    return F.when(F.size(p) == F.size(q), total(terms))


def decision_score(logits: Column, letter: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Position of a letter's logit between the smallest and largest of its layer; NULL if not offered."""
    low = F.array_min(logits) if low is None else low
    high = F.array_max(logits) if high is None else high
    value = F.get(logits, letter_index(letter))
    return (value - low) / (high - low + F.lit(SCORE_EPS))


def entropy(probabilities: Column) -> Column:
    return -total(F.transform(probabilities, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))))


def top_letter(values: Column) -> Column:
    """Letter of the largest value; the first one wins a tie."""
    return F.chr((64 + F.array_position(values, F.array_max(values))).cast("int"))


def top_k(values: Column, k: int) -> Column:
    """The k largest (value, position) pairs, largest first, the earlier position first in a tie."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("key"), i.alias("pos"), v.alias("value")))
    return F.transform(
        F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["pos"].alias("pos"), s["value"].alias("value"))
    )


def answer_probabilities(logits: Column) -> Column:
    """Normalised probabilities of the last layer; -inf counts as 0, uniform if nothing is left."""
    finite = F.transform(logits, lambda v: F.when(v == F.lit(float("-inf")), F.lit(None)).otherwise(v))
    top = F.array_max(finite)
    weights = F.transform(finite, lambda v: F.coalesce(F.exp(v - top), F.lit(0.0)))
    shares = F.get(
        F.transform(
            F.array(F.struct(weights.alias("w"), total(weights).alias("t"))),
            lambda s: F.transform(s["w"], lambda v: v / s["t"]),
        ),
        F.lit(0),
    )
    uniform = F.transform(logits, lambda v: F.lit(1.0) / F.size(logits))
    return F.when(top.isNull(), uniform).otherwise(shares)


def misleading_confidence(probabilities: Column, correct: Column, suggested: Column) -> Column:
    """Probability of the suggested option, or of the best wrong option where none or the right one is suggested."""
    right = letter_index(correct)
    best_wrong = F.array_max(
        F.transform(probabilities, lambda p, i: F.when(i != right, p))
    )
    uses_opinion = suggested.isNotNull() & (suggested != correct)
    return F.when(uses_opinion, F.coalesce(F.get(probabilities, letter_index(suggested)), F.lit(0.0))).otherwise(
        best_wrong
    )


def stronger_token(bare: Column, spaced: Column) -> Column:
    """A letter's logit is the larger of its bare and its space-prefixed token."""
    return F.greatest(bare, spaced)
