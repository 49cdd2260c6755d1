"""Feature table to the table of text, feature and hybrid vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.functions.text import build_document
from trackweave.functions.vectors import FEATURE_WEIGHT, TEXT_WEIGHT, hybrid_vector
from trackweave.operators.scaling import feature_vectors
from trackweave.operators.text_vectors import DIMENSION, HashedTextModel, fit_hashed_text


def document(df: DataFrame, fields: Sequence[str] = schemas.TEXT_FIELDS, tags: Sequence[str] = schemas.TAG_FIELDS) -> DataFrame:
    """Add ``document``, the text the text vector is made of."""
    return df.withColumn(
        "document",
        build_document(
            [F.col(f) for f in fields if f in df.columns], [F.col(t) for t in tags if t in df.columns]
        ),
    )


def combine(df: DataFrame, text_weight: float = TEXT_WEIGHT, feature_weight: float = FEATURE_WEIGHT) -> DataFrame:
    """Hybrid vector and its dimension; NULL and 0 where a part is missing."""
    if "text_embedding" not in df.columns or "feature_embedding" not in df.columns:
        return df
    joined = hybrid_vector(F.col("text_embedding"), F.col("feature_embedding"), text_weight, feature_weight)
    return df.withColumn("combined_embedding", joined).withColumn(
        "combined_dimension", F.coalesce(F.size("combined_embedding"), F.lit(0))
    )


@dataclass(frozen=True)
class Embedded:
    vectors: DataFrame
    text_model: HashedTextModel


def build_vectors(
    features: DataFrame,
    scaler: str = "standard",
    dimension: int = DIMENSION,
    numeric: Sequence[str] = schemas.NUMERIC_FEATURES,
) -> Embedded:
    """All three vectors per row; the fitted text model also embeds later queries."""
    documents = document(features)
    model = fit_hashed_text(documents, "document", dimension)
    texts = model.transform(documents, "document").withColumn("embedding_dimension", F.lit(dimension))
    return Embedded(combine(feature_vectors(texts, numeric, scaler)), model)
