"""Score scaling, blending and vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(score: Column) -> Column:
    """NaN becomes null: it would sort above all numbers."""
    return F.when(~F.isnan(score), score)


def min_max(score: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) within a group's range; -1 where all are equal."""
    return F.when(score.isNotNull(), F.coalesce(F.try_divide(score - low, high - low), F.lit(-1.0)))


def min_max_eps(score: Column, low: Column, high: Column, eps: float = 1e-4) -> Column:
    """(x - low) / (high - low + eps) within a group's range."""
    return (score - low) / (high - low + F.lit(eps))


def min_max_ones(score: Column, low: Column, high: Column, eps: float = 1e-4) -> Column:
    """min_max_eps(), but 1 where all are equal."""
    return F.when(score.isNull(), None).when(high == low, 1.0).otherwise(min_max_eps(score, low, high, eps))


def blend(a: Column, b: Column, weight: Column) -> Column:
    return weight * a + (F.lit(1.0) - weight) * b


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax(logits: Column) -> Column:
    """The place, from 0, of the largest of an array of logits, the first of equal ones; null for null and empty arrays."""
    place = F.array_position(logits, F.array_max(logits)) - 1
    return F.when(F.size(logits) > 0, place.cast("int"))


def token_probability(logits: Column, token: Column | int) -> Column:
    """The probability of one token among the logits of a vocabulary: exp(log_softmax(logits)[token]); null if there's no such token."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.exp(F.get(logits, token if isinstance(token, Column) else F.lit(token)).cast("double") - top) / total


def softmax_second(first: Column, second: Column) -> Column:
    """The share of the second of two logits."""
    top = F.greatest(first, second)
    return F.exp(second - top) / (F.exp(first - top) + F.exp(second - top))


def f2(precision: Column, recall: Column) -> Column:
    """The F score that counts recall twice; 0 where both are 0."""
    return F.coalesce(F.try_divide(F.lit(5.0) * precision * recall, F.lit(4.0) * precision + recall), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
