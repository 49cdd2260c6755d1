"""Column functions over numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A decimal literal; keeps Java's type suffixes ("1d") and hexadecimal floats out of the cast.
DECIMAL = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"

# Bin edges and their names.
POPULARITY_EDGES = (0.0, 20.0, 40.0, 60.0, 80.0, 100.0)
POPULARITY_LABELS = ("very_low", "low", "medium", "high", "very_high")
DURATION_EDGES = (0.0, 2.0, 3.5, 5.0, 10.0, float("inf"))
DURATION_LABELS = ("very_short", "short", "medium", "long", "very_long")
POPULAR_FROM = 60
SHORT_BELOW_MINUTES = 3
LONG_ABOVE_MINUTES = 5


def not_nan(number: Column) -> Column:
    return F.nanvl(number, F.lit(None).cast("double"))


def to_number(df: DataFrame, field: str) -> Column:
    """Field as double, NULL where it does not parse; booleans become 0 and 1."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.StringType):
        return F.regexp_extract(F.col(field), DECIMAL, 0).try_cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return not_nan(F.col(field).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(field).cast("double")
    return F.lit(None).cast("double")


def in_range(number: Column, lower: float, upper: float) -> Column:
    """The number, or NULL outside the closed range."""
    return F.when(number.between(lower, upper), number)


def bin_label(
    number: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
    null_label: str | None = "nan",
) -> Column:
    """Name of the right-closed bin ``(edge, next edge]`` that holds the number."""
    inside = number >= edges[0] if include_lowest else number > edges[0]
    label = F.when(number.isNull() | ~inside, F.lit(null_label).cast("string"))
    for upper, name in zip(edges[1:], labels):
        label = label.when(F.lit(True) if upper == float("inf") else number <= upper, F.lit(name))
    return label.otherwise(F.lit(null_label).cast("string"))


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def popularity_features(popularity: Column, null_label: str | None = "nan") -> dict[str, Column]:
    return {
        "popularity_normalized": popularity / F.lit(100.0),
        "popularity_bin": bin_label(popularity, POPULARITY_EDGES, POPULARITY_LABELS, True, null_label),
        "is_popular": flag(popularity >= POPULAR_FROM),
    }


def duration_features(duration_ms: Column, null_label: str | None = "nan") -> dict[str, Column]:
    seconds = duration_ms / F.lit(1000.0)
    minutes = seconds / F.lit(60.0)
    return {
        "duration_seconds": seconds,
        "duration_minutes": minutes,
        "duration_category": bin_label(minutes, DURATION_EDGES, DURATION_LABELS, False, null_label),
        "is_short_track": flag(minutes < SHORT_BELOW_MINUTES),
        "is_long_track": flag(minutes > LONG_ABOVE_MINUTES),
    }


def percentage(score: Column) -> Column:
    """Score as whole per cent, halves rounded up."""
    return F.floor(score * 100 + F.lit(0.5)).cast("int")
