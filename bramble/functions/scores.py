"""Scores, probabilities and similarities as column functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_log(x: Column, epsilon: float = 1e-5) -> Column:
    return F.log(x + epsilon)


def softmax(score: Column, *by: str) -> Column:
    """Share of exp(score) among the rows of a group, shifted by its largest score."""
    group = Window.partitionBy(*by)
    shifted = F.exp(score - F.max(score).over(group))
    return shifted / F.sum(shifted).over(group)


def normalised_sigmoid(score: Column, *by: str) -> Column:
    s = sigmoid(score)
    return s / F.sum(s).over(Window.partitionBy(*by))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def multi_hot(ids: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(ids, i).cast("int"))
