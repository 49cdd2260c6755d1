"""Column functions over ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.binding import once

METRICS = ("cosine", "euclidean", "dot")
TEXT_WEIGHT = 0.7
FEATURE_WEIGHT = 0.3


def as_vector(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _squared_length(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(_squared_length(vector))


def _or_one(number: Column) -> Column:
    return F.when(number == 0, F.lit(1.0)).otherwise(number)


def l2_normalize(vector: Column) -> Column:
    """Vector of length 1; the zero vector stays as it is."""
    scaled = once(_or_one(l2_norm(vector)), lambda norm: F.transform(vector, lambda x: x / norm))
    return F.when(vector.isNotNull(), scaled)


def similarity(left: Column, right: Column, metric: str = "cosine") -> Column:
    """Pair similarity: cosine (0 for a zero vector), ``1 / (1 + distance)`` or the dot product."""
    if metric == "cosine":
        return dot(left, right) / _or_one(l2_norm(left) * l2_norm(right))
    if metric == "euclidean":
        gaps = F.zip_with(left, right, lambda a, b: a - b)
        return F.lit(1.0) / (F.lit(1.0) + l2_norm(gaps))
    if metric == "dot":
        return dot(left, right)
    raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def hybrid_vector(
    text: Column,
    features: Column,
    text_weight: float = TEXT_WEIGHT,
    feature_weight: float = FEATURE_WEIGHT,
    normalize: bool = True,
) -> Column:
    """Weighted concatenation of two vectors, NULL when either is NULL."""

    def joined(text_factor: Column, feature_factor: Column) -> Column:
        return F.concat(
            F.transform(text, lambda x: x * text_factor),
            F.transform(features, lambda x: x * feature_factor),
        )

    if not normalize:
        return joined(F.lit(text_weight), F.lit(feature_weight))

    # Both normalisations fold into one factor per part: the squared length of the weighted
    # concatenation is the sum of the squared weights of the parts that are not zero.
    def factors(norms: Column) -> Column:
        squared = F.when(norms["t"] > 0, F.lit(text_weight**2)).otherwise(F.lit(0.0)) + F.when(
            norms["f"] > 0, F.lit(feature_weight**2)
        ).otherwise(F.lit(0.0))
        length = _or_one(F.sqrt(squared))
        return F.struct(
            (F.lit(text_weight) / (_or_one(norms["t"]) * length)).alias("t"),
            (F.lit(feature_weight) / (_or_one(norms["f"]) * length)).alias("f"),
        )

    norms = F.struct(l2_norm(text).alias("t"), l2_norm(features).alias("f"))
    combined = once(once(norms, factors), lambda factor: joined(factor["t"], factor["f"]))
    return F.when(text.isNotNull() & features.isNotNull(), combined)
