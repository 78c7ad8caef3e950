"""Dense vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric name -> is a larger score better?
METRICS = {"cosine": True, "dot": True, "euclid": False, "manhattan": False}


def metric_name(distance: str) -> str:
    """Distance names are case-insensitive; an unknown one is an error."""
    name = distance.lower()
    if name not in METRICS:
        raise ValueError(f"Unsupported distance: {distance}")
    return name


def _fold(a: Column, b: Column, pair) -> Column:
    terms = F.zip_with(a, b, lambda x, y: pair(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def score(metric: str, a: Column, b: Column) -> Column:
    """Score of one pair as an expression; null where cosine meets a zero vector."""
    metric = metric_name(metric)
    if metric == "cosine":
        scale = norm(a) * norm(b)
        value = F.when(scale > 0, dot(a, b) / scale)
    elif metric == "dot":
        value = dot(a, b)
    elif metric == "euclid":
        value = F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))
    else:
        value = _fold(a, b, lambda x, y: F.abs(x - y))
    return F.round(value, 6)


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & x.isNotNull()


def first_bad(values: Column) -> Column:
    """Position (from 0) of the first value that is not a finite number; null if there is none."""
    marks = F.transform(values, lambda x: ~is_finite(x.cast("double")))
    at = F.array_position(marks, F.lit(True))
    return F.when(at > 0, at - 1)


def normalise(v: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    from vecloom.functions.text import bind

    return bind(
        norm(v),
        lambda n: F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v),
    )
