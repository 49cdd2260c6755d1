"""Numeric feature vectors: median fill, three scalers, optional PCA."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.functions.numeric import not_nan
from trackweave.functions.vectors import as_vector
from trackweave.operators.order_stats import medians, quantiles, summarize

PCA_DIMENSION = 50


@dataclass(frozen=True)
class ScaledFeature:
    name: str
    fill: float | None
    center: float
    scale: float


@dataclass(frozen=True)
class FeatureScaler:
    features: tuple[ScaledFeature, ...]

    def transform(self, df: DataFrame, output: str = "feature_embedding") -> DataFrame:
        """Add the scaled vector. A column without any value contributes 0."""
        if not self.features:
            return df
        scaled = []
        for feature in self.features:
            if feature.fill is None:
                scaled.append(F.lit(0.0))
            else:
                value = F.coalesce(_number(feature.name), F.lit(feature.fill))
                scaled.append((value - F.lit(feature.center)) / F.lit(feature.scale))
        return df.withColumn(output, F.array(*scaled))


def _number(name: str):
    return not_nan(F.col(name).cast("double"))


def fit_scaler(df: DataFrame, features: Sequence[str] = schemas.NUMERIC_FEATURES, kind: str = "standard") -> FeatureScaler:
    """Fit on the available columns; an unknown kind means ``standard``.

    standard: mean and population deviation. minmax: range. robust: exact median and quartiles.
    Constant columns scale to 0. Spark ML's scalers differ on all three points (sample deviation, 0.5
    for constants, approximate quantiles).
    """
    available = [name for name in features if name in df.columns]
    if not available:
        return FeatureScaler(())
    columns = {name: _number(name) for name in available}
    facts = summarize(df, columns)
    # The median is only needed where something is missing.
    gappy = {n: columns[n] for n in available if facts[n].filled and facts[n].missing}
    fills = medians(df, gappy, {n: facts[n].filled for n in gappy}) if gappy else {}
    fills.update({n: facts[n].low for n in available if facts[n].filled and not facts[n].missing})

    quartiles = {}
    if kind == "robust":
        filled = {n: F.coalesce(columns[n], F.lit(fills[n])) for n in available if facts[n].filled}
        rows = {n: facts[n].rows for n in filled}
        quartiles = quantiles(df, filled, [0.25, 0.5, 0.75], rows) if filled else {}

    fitted = []
    for name in available:
        fact = facts[name]
        if not fact.filled:
            fitted.append(ScaledFeature(name, None, 0.0, 1.0))
            continue
        if fact.low == fact.high:
            center, scale = fact.low, 1.0
        elif kind == "minmax":
            center, scale = fact.low, fact.high - fact.low
        elif kind == "robust":
            lower, center, upper = quartiles[name]
            scale = (upper - lower) or 1.0
        else:
            gap = fills[name] - fact.mean if fact.missing else 0.0
            center = fact.mean + gap * fact.missing / fact.rows
            deviation = fact.deviation + gap * gap * fact.filled * fact.missing / fact.rows
            scale = math.sqrt(deviation / fact.rows) or 1.0
        fitted.append(ScaledFeature(name, fills[name], center, scale))
    return FeatureScaler(tuple(fitted))


@dataclass(frozen=True)
class Projection:
    """Fitted PCA. Only d x k numbers live on the driver."""

    model: PCAModel
    shift: tuple[float, ...]
    signs: tuple[float, ...]

    @property
    def explained_variance_ratio(self) -> list[float]:
        return [float(x) for x in self.model.explainedVariance.toArray()]

    def transform(self, df: DataFrame, vector: str, output: str) -> DataFrame:
        """Centred projection; every component's largest loading is positive. A NULL vector stays NULL."""
        zero = F.array(*[F.lit(0.0)] * self.model.pc.numRows)
        prepared = df.withColumn("_in", array_to_vector(F.coalesce(as_vector(F.col(vector)), zero)))
        known = self.model.setInputCol("_in").setOutputCol("_out").transform(prepared)
        turned = F.array(
            *[
                (F.get(F.col("_raw"), F.lit(i)) - F.lit(shift)) * F.lit(sign)
                for i, (shift, sign) in enumerate(zip(self.shift, self.signs))
            ]
        )
        projected = known.withColumn("_raw", vector_to_array("_out")).withColumn(output, F.when(F.col(vector).isNotNull(), turned))
        return projected.drop("_in", "_out", "_raw")


def fit_projection(df: DataFrame, vector: str, dimension: int = PCA_DIMENSION) -> Projection:
    vectors = df.filter(F.col(vector).isNotNull()).select(array_to_vector(as_vector(F.col(vector))).alias("_in"))
    model = PCA(k=dimension, inputCol="_in", outputCol="_out").fit(vectors)
    loadings = model.pc.toArray()
    # ML's projection does not centre; subtract the projected mean instead of centring every row.
    shift = vectors.select(Summarizer.mean(F.col("_in"))).first()[0].toArray() @ loadings
    peaks = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return Projection(model, tuple(map(float, shift)), tuple(1.0 if p >= 0 else -1.0 for p in peaks))


def feature_vectors(
    df: DataFrame,
    features: Sequence[str] = schemas.NUMERIC_FEATURES,
    kind: str = "standard",
    use_pca: bool = True,
    dimension: int = PCA_DIMENSION,
    output: str = "feature_embedding",
) -> DataFrame:
    """Scaled vector per row plus its dimension; PCA only when there are more features than wanted."""
    scaler = fit_scaler(df, features, kind)
    if not scaler.features:
        return df
    scaled = scaler.transform(df, output)
    width = len(scaler.features)
    if use_pca and width > dimension:
        scaled = fit_projection(scaled, output, dimension).transform(scaled, output, output)
        width = dimension
    return scaled.withColumn("feature_dimension", F.lit(width))
