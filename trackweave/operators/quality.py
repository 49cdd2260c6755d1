"""Data-quality report and run metrics. Checks report, they never stop a build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.functions.dates import parse_date

MIN_COMPLETENESS = 0.7
MAX_DUPLICATES = 0.05
MIN_VALID_DATES = 0.9


def quality_report(
    df: DataFrame,
    required: Sequence[str] = schemas.REQUIRED_FIELDS,
    key: str = "track_id",
    date_field: str | None = None,
    min_completeness: float = MIN_COMPLETENESS,
    max_duplicates: float = MAX_DUPLICATES,
    min_valid_dates: float = MIN_VALID_DATES,
) -> DataFrame:
    """Rows ``check, field, value, threshold, passed``: presence, completeness, duplicates, overall.

    One aggregate over the table. NULL keys count as equal to each other, as duplicates do in pandas.
    """
    present = [field for field in required if field in df.columns]
    measures = {f"complete_{field}": F.avg(F.col(field).isNotNull().cast("double")) for field in present}
    if key in df.columns:
        distinct = F.count_distinct(F.col(key)) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))
        measures["duplicates"] = F.try_divide((F.count(F.lit(1)) - distinct).cast("double"), F.count(F.lit(1)).cast("double"))
    if date_field and date_field in df.columns:
        valid = parse_date(F.col(date_field).cast("string")).isNotNull()
        measures["valid_dates"] = F.avg(valid.cast("double"))
    measured = df.agg(*[column.alias(name) for name, column in measures.items()]) if measures else df.limit(0)

    def line(check: str, field: str, value, threshold: float, at_least: bool):
        value = value.cast("double")
        good = value >= threshold if at_least else value <= threshold
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(field).alias("field"),
            value.alias("value"),
            F.lit(float(threshold)).alias("threshold"),
            F.coalesce(good, F.lit(True)).alias("passed"),
        )

    lines = [line("required", f, F.lit(float(f in df.columns)), 1.0, True) for f in required]
    lines += [line("completeness", f, F.col(f"complete_{f}"), min_completeness, True) for f in present]
    if "duplicates" in measures:
        lines.append(line("duplicates", key, F.col("duplicates"), max_duplicates, False))
    if "valid_dates" in measures:
        lines.append(line("valid_dates", date_field, F.col("valid_dates"), min_valid_dates, True))
    checks = F.array(*lines)
    failed = F.size(F.filter(checks, lambda entry: ~entry["passed"]))
    overall = line("overall", "*", (failed == 0).cast("double"), 1.0, True)
    return measured.select(F.inline(F.concat(checks, F.array(overall))))


def row_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows a step received, kept and dropped, as one row."""
    received = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    return after.agg(F.count(F.lit(1)).alias("records_modified")).select(
        received.alias("records_processed"),
        "records_modified",
        (received - F.col("records_modified")).alias("records_dropped"),
    )


def retention(raw: DataFrame, clean: DataFrame, features: DataFrame) -> DataFrame:
    """Rows in and out of cleaning and the number of columns the features added."""
    rows_in = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return clean.agg(F.count(F.lit(1)).alias("rows_out")).select(
        rows_in.alias("rows_in"),
        "rows_out",
        (rows_in - F.col("rows_out")).alias("rows_removed"),
        F.try_divide(F.col("rows_out").cast("double"), rows_in.cast("double")).alias("retention_rate"),
        F.lit(len(features.columns) - len(clean.columns)).alias("new_columns"),
    )


def vector_coverage(
    df: DataFrame, columns: Sequence[str] = ("text_embedding", "feature_embedding", "combined_embedding")
) -> DataFrame:
    """Rows, non-null vectors and dimension per vector column, as one row."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for name in columns:
        if name in df.columns:
            measures += [F.count(name).alias(f"{name}_count"), F.max(F.size(name)).alias(f"{name}_dimension")]
    return df.agg(*measures)
