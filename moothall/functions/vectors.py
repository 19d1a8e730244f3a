"""Vector, logit and probability expressions over arrays (G6, G7, R6, R7, cosine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_NORM = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(SMALLEST_NORM))
    return F.transform(F.array(length), lambda n: F.transform(a.cast("array<double>"), lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(SMALLEST_NORM))


def argmax(a: Column) -> Column:
    """Zero-based index of the largest value, the lowest one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_softmax(a: Column) -> Column:
    peak = F.array_max(a)
    shifted = F.transform(F.array(peak), lambda m: F.transform(a, lambda x: x - m))[0]
    return F.transform(F.array(shifted), lambda s: F.transform(F.array(F.ln(total(F.transform(s, F.exp)))), lambda z: (
        F.transform(s, lambda x: x - z)))[0])[0]


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log probability of the label."""
    return -F.get(log_softmax(logits), label.cast("int"))


def entropy(logits: Column) -> Column:
    """Entropy of one position's distribution."""
    return F.aggregate(log_softmax(logits), F.lit(0.0), lambda acc, lp: acc - lp * F.exp(lp))


def margin_loss(logits: Column, label: Column, kappa: float = 5.0) -> Column:
    """How far the label's score, plus a margin, stays above the best other score."""
    others = F.filter(logits, lambda x, i: i != label)
    return F.greatest(F.get(logits, label.cast("int")) - F.array_max(others) + F.lit(kappa), F.lit(0.0))
