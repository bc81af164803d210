"""Column expressions on array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector has cosine 0 with everything."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def unit(a: Column) -> Column:
    """Unit-length copy; the length is floored at 1e-12, so zero vectors stay zero."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda v: v.cast("double") / length)


def leading_dims(a: Column, ratio: float) -> Column:
    """The first ``int(d * ratio)`` elements."""
    return F.slice(a, F.lit(1), F.floor(F.size(a) * F.lit(ratio)).cast("int"))


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def latent_kl(mu: Column, log_var: Column) -> Column:
    """-1/2 * sum(1 + log_var - mu^2 - exp(log_var)) of one row."""
    terms = F.zip_with(mu, log_var, lambda m, lv: F.lit(1.0) + lv - m * m - F.exp(lv))
    return F.lit(-0.5) * total(terms)
