"""Numeric functions over scalars and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_exp(x: Column) -> Column:
    """exp with fixed cut-offs: 0 below -745, infinity above 709."""
    return F.when(x < -745, F.lit(0.0)).when(x > 709, F.lit(float("inf"))).otherwise(F.exp(x))


def softmax_entropy(logits: Column) -> Column:
    """Entropy in nats of the softmax of an array; probabilities that underflow add nothing."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda v: F.exp(v.cast("double") - top))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    # one array of weights, read by both sums
    return F.element_at(
        F.transform(F.array(F.struct(weights.alias("w"), total(weights).alias("z"))), lambda s: -total(F.transform(s["w"], lambda w: F.coalesce((w / s["z"]) * F.ln(w / s["z"]), F.lit(0.0))))),
        1,
    )


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def evenly_spaced(n: Column, most: int) -> Column:
    """At most most indices from 0 to n - 1, evenly spaced, halves to even, distinct and sorted."""
    if most == 1:
        some = F.array(F.lit(0))
    else:
        some = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1)), 0).cast("int"))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(some)
