"""Text and numeric cleaning. Statistics are fitted first; applying them is one narrow pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave import schemas
from trackweave.functions.binding import once
from trackweave.functions.numeric import in_range, to_number
from trackweave.functions.text import normalize_text
from trackweave.operators.order_stats import ColumnSummary, medians, summarize


@dataclass(frozen=True)
class Range:
    field: str
    lower: float
    upper: float


# Valid ranges, in the order the fields are cleaned.
RANGES = (
    Range("popularity", 0, 100),
    Range("duration_ms", 0, 3_600_000),
    Range("explicit", 0, 1),
)
OUTLIER_DEVIATIONS = 3.0


def clean_text(
    df: DataFrame,
    fields: Sequence[str] = schemas.TEXT_FIELDS,
    required: Sequence[str] = ("track_name", "artist_name"),
    min_length: int = 1,
    max_length: int = 500,
) -> DataFrame:
    """Normalise the text fields that exist and drop rows without the required ones."""
    cleaned = [f for f in fields if f in df.columns]
    needed = [f for f in required if f in df.columns]
    if not cleaned:
        return df.dropna(subset=needed)
    texts = F.struct(*[normalize_text(F.col(f), min_length, max_length).alias(f) for f in cleaned])

    def complete(row: Column) -> Column:
        return reduce(Column.__and__, [row[f].isNotNull() for f in needed if f in cleaned], F.lit(True))

    # Zero or one struct per row. A filter after a projection would be pushed below it together with
    # a copy of every regular expression.
    kept = df.dropna(subset=needed).select(
        *[F.col(c) for c in df.columns if c not in cleaned], F.inline(F.filter(F.array(texts), complete))
    )
    return kept.select(*df.columns)


@dataclass(frozen=True)
class FieldCleaning:
    """Fitted values for one field; None where nothing is filled or cut."""

    valid: Range
    fill: float | None = None
    keep_from: float | None = None
    keep_to: float | None = None

    def filled(self, value: Column) -> Column:
        return value if self.fill is None else F.coalesce(value, F.lit(self.fill))

    def kept(self, value: Column) -> Column:
        if self.keep_from is None:
            return F.lit(True)
        return value.isNull() | value.between(self.keep_from, self.keep_to)


@dataclass(frozen=True)
class NumericCleaner:
    steps: tuple[FieldCleaning, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Literals only: one narrow pass without joins or shuffles."""
        for step in self.steps:
            df = _apply(df, step)
        return df

    def metrics(self, df: DataFrame) -> DataFrame:
        """One row of counters. Values nulled by the range check do not count as filled."""
        alive, filled, removed = F.lit(True), F.lit(0), F.lit(0)
        for step in self.steps:
            if step.fill is not None:
                filled = filled + (alive & to_number(df, step.valid.field).isNull()).cast("int")
            value = step.filled(_valid_number(df, step.valid))
            stays = once(value, step.kept) if _is_text(df, step.valid.field) else step.kept(value)
            removed = removed + (alive & ~stays).cast("int")
            alive = alive & stays
        counters = df.select(alive.alias("alive"), filled.alias("filled"), removed.alias("removed"))
        return counters.agg(
            F.count(F.lit(1)).alias("records_processed"),
            F.count_if("alive").alias("records_modified"),
            F.coalesce(F.sum("filled"), F.lit(0)).alias("missing_filled"),
            F.coalesce(F.sum("removed"), F.lit(0)).alias("outliers_removed"),
        )


def _is_text(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.StringType)


def _valid_number(df: DataFrame, valid: Range) -> Column:
    """Number within the range, else NULL. Parsing a string is costly enough to do it only once."""
    number = to_number(df, valid.field)
    if _is_text(df, valid.field):
        return once(number, lambda n: in_range(n, valid.lower, valid.upper))
    return in_range(number, valid.lower, valid.upper)


def _apply(df: DataFrame, step: FieldCleaning) -> DataFrame:
    name = step.valid.field
    cleaned = df.withColumn(name, step.filled(_valid_number(df, step.valid)))
    if step.keep_from is None:
        return cleaned
    return cleaned.filter(once(F.col(name), step.kept) if _is_text(df, name) else step.kept(F.col(name)))


def fit_numeric_cleaner(
    df: DataFrame,
    ranges: Sequence[Range] = RANGES,
    outlier_fields: Sequence[str] | None = None,
    deviations: float = OUTLIER_DEVIATIONS,
    fill_missing: bool = True,
) -> NumericCleaner:
    """Learn median fill and outlier bounds field by field, each on the survivors of the former.

    Per field two scans of one column: moments, then the exact median; one for a small table. Moments
    of the filled column follow from the count of filled values, so they need no scan of their own.
    """
    steps: list[FieldCleaning] = []
    current, known_rows = df, None
    for valid in ranges:
        if valid.field not in current.columns:
            continue
        value = _valid_number(current, valid)
        facts = summarize(current, {"value": value}, known_rows)["value"]
        known_rows = facts.rows
        fill = facts.median
        if fill is None and facts.filled and fill_missing:
            fill = medians(current, {"value": value}, {"value": facts.filled})["value"]
        if not fill_missing:
            fill = None
        bounded = outlier_fields is None or valid.field in outlier_fields
        step = FieldCleaning(valid, fill, *(_bounds(facts, fill, deviations) if bounded else (None, None)))
        steps.append(step)
        current = _apply(current, step)
    return NumericCleaner(tuple(steps))


def _bounds(facts: ColumnSummary, fill: float | None, deviations: float) -> tuple[float | None, float | None]:
    """Closed interval of values that are no outliers once ``fill`` stands for the missing ones."""
    added = facts.missing if fill is not None else 0
    n = facts.filled + added
    if n < 2 or not facts.filled:
        return None, None
    if facts.low == facts.high:
        return facts.low, facts.high
    gap = (fill - facts.mean) if added else 0.0
    mean = facts.mean + gap * added / n
    deviation = facts.deviation + gap * gap * facts.filled * added / n
    reach = deviations * math.sqrt(deviation / (n - 1))
    return mean - reach, mean + reach
