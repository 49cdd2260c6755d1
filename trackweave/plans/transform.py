"""Raw table to clean table, feature table and quality report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.functions.dates import parse_date, temporal_features
from trackweave.functions.numeric import duration_features, popularity_features
from trackweave.functions.tags import clean_playcount, tag_features
from trackweave.functions.text import build_document, text_shape
from trackweave.operators.cleaning import RANGES, NumericCleaner, clean_text, fit_numeric_cleaner
from trackweave.operators.quality import quality_report
from trackweave.session import materialize


def rename(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(schemas.RENAMED)


def build_clean(raw: DataFrame, outlier_fields: Sequence[str] | None = None) -> tuple[DataFrame, NumericCleaner]:
    """Clean rows and the fitted cleaner (for its counters).

    The cleaner scans its input several times, so it gets the few numbers of the surviving rows from
    a checkpoint instead of cleaning all texts again for every scan.
    """
    texts = clean_text(rename(raw))
    numbers = [valid.field for valid in RANGES if valid.field in texts.columns]
    fitted_on = materialize(texts.select(*numbers)) if numbers else texts
    cleaner = fit_numeric_cleaner(fitted_on, outlier_fields=outlier_fields)
    clean = cleaner.transform(texts)
    if "lastfm" in clean.columns:
        clean = clean.withColumn("lastfm_playcount", clean_playcount(F.col("lastfm.playcount")))
    return clean, cleaner


def build_features(
    clean: DataFrame,
    as_of_year: int,
    date_formats: Sequence[str] = ("yyyy-MM-dd",),
    null_label: str | None = "nan",
    text_shapes: bool = False,
) -> DataFrame:
    """Feature groups of the input columns that exist; one projection, no shuffle."""
    df = clean
    if "popularity" in df.columns:
        df = df.withColumns(popularity_features(F.col("popularity"), null_label))
    if "duration_ms" in df.columns:
        df = df.withColumns(duration_features(F.col("duration_ms"), null_label))
    if "release_date" in df.columns:
        df = df.withColumn("release_date", parse_date(F.col("release_date").cast("string"), date_formats))
        df = df.withColumns(temporal_features(F.col("release_date"), as_of_year))
    if "lastfm" in df.columns:
        df = df.withColumns(tag_features(df))
    if text_shapes:
        fields = [F.col(f) for f in schemas.TEXT_FIELDS if f in df.columns]
        df = df.withColumn("combined_text", build_document(fields))
        df = df.withColumns(text_shape(F.col("combined_text")))
    return df


@dataclass(frozen=True)
class Transformed:
    clean: DataFrame
    features: DataFrame
    report: DataFrame
    cleaner: NumericCleaner


def transform(raw: DataFrame, as_of_year: int, outlier_fields: Sequence[str] | None = None) -> Transformed:
    clean, cleaner = build_clean(raw, outlier_fields)
    features = build_features(clean, as_of_year)
    return Transformed(clean, features, quality_report(features), cleaner)
