"""Evaluation metrics over per-token model outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmeter.functions import prob as P


def negative_log_likelihood(logits: Column, target: Column) -> Column:
    """−ln softmax(logits)[target], with the largest logit taken off first."""
    top = F.array_max(logits)
    return F.ln(P.total(F.transform(logits, lambda v: F.exp(v - top)))) + top - F.get(logits, target)


def perplexity(tokens: DataFrame, keys: Sequence[str], nll: str = "nll", n_tokens: str | None = None) -> DataFrame:
    """exp(Σ nll / Σ tokens). With ``n_tokens`` each row carries a mean over that many tokens."""
    count = F.col(n_tokens) if n_tokens else F.lit(1)
    total = F.sum(F.col(nll) * count)
    return tokens.groupBy(*keys).agg(F.exp(total / F.sum(count)).alias("perplexity"), F.sum(count).alias("n_tokens"))


def token_consistency(left: DataFrame, right: DataFrame, on: Sequence[str], keys: Sequence[str], logits: str = "logits") -> DataFrame:
    """Share of tokens for which two models favour the same continuation."""
    a = left.select(*on, *[k for k in keys if k not in on], P.top_letter(F.col(logits)).alias("_a"))
    b = right.select(*on, P.top_letter(F.col(logits)).alias("_b"))
    same = (F.col("_a") == F.col("_b")).cast("double")
    return a.join(b, list(on)).groupBy(*keys).agg(F.avg(same).alias("consistency"), F.count(F.lit(1)).alias("n"))


def top1_accuracy(rows: DataFrame, logits: str, target: Column, keys: Sequence[str]) -> DataFrame:
    """Percentage of rows whose largest logit is at the target."""
    hit = (F.array_position(logits, F.array_max(logits)) - 1 == target).cast("double")
    return rows.groupBy(*keys).agg((100 * F.avg(hit)).alias("accuracy"), F.count(F.lit(1)).alias("n"))
