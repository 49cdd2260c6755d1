"""Text to vectors: a user-supplied model over Arrow batches, or hashed TF-IDF without any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.session import ship_package

DIMENSION = 768
BATCH_SIZE = 25
ERROR = "embedding_error"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits of any alphabet, whatever separates them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")


@dataclass(frozen=True)
class HashedTextModel:
    """Term frequencies hashed to a fixed dimension, weighted by IDF, scaled to length 1."""

    dimension: int
    idf: IDFModel

    def transform(self, df: DataFrame, text: str, output: str = "text_embedding") -> DataFrame:
        """No shuffle; a NULL text gives a NULL vector."""
        counted = _hashed(df, text, self.dimension)
        weighted = self.idf.setInputCol("_tf").setOutputCol("_weighted").transform(counted)
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit").transform(weighted)
        vector = F.when(F.col(text).isNotNull(), vector_to_array("_unit"))
        return unit.withColumn(output, vector).drop("_words", "_tf", "_weighted", "_unit")


def _hashed(df: DataFrame, text: str, dimension: int) -> DataFrame:
    words = df.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit(""))))
    return HashingTF(numFeatures=dimension, inputCol="_words", outputCol="_tf").transform(words)


def fit_hashed_text(df: DataFrame, text: str, dimension: int = DIMENSION) -> HashedTextModel:
    """Document frequencies come from one tree aggregation of a ``dimension``-long vector."""
    counted = _hashed(df.filter(F.col(text).isNotNull()).select(text), text, dimension)
    return HashedTextModel(dimension, IDF(inputCol="_tf", outputCol="_weighted").fit(counted))


def embed_with(
    df: DataFrame,
    text: str,
    embed: Callable[[list[str]], Sequence[Sequence[float]]],
    dimension: int = DIMENSION,
    batch_size: int = BATCH_SIZE,
    output: str = "text_embedding",
) -> DataFrame:
    """Call ``embed`` on batches of texts inside the tasks; a failing batch leaves NULL vectors and says why.

    Adds the vector, ``embedding_error`` (NULL where all went well) and ``embedding_dimension``. ``require_embedded``
    raises when too many rows failed.
    """
    added = [T.StructField(output, T.ArrayType(T.DoubleType())), T.StructField(ERROR, T.StringType())]
    schema = T.StructType([field for field in df.schema.fields if field.name not in (output, ERROR)] + added)
    kept = [field.name for field in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, vectors, errors = [value or "" for value in batch.column(text).to_pylist()], [], []
            for start in range(0, len(texts), batch_size):
                some = texts[start : start + batch_size]
                found, error = _guarded(embed, some)
                vectors += found
                errors += [error] * len(some)
            new = [pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], schema.names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema).withColumn("embedding_dimension", F.lit(dimension))


def _guarded(embed, texts: list[str]) -> tuple[list[list[float] | None], str | None]:
    """The model's failure, whatever it is, costs this batch only, and is told."""
    try:
        vectors = [[float(x) for x in vector] for vector in embed(texts)]
    except Exception as failure:
        return [None] * len(texts), f"{type(failure).__name__}: {failure}"
    if len(vectors) != len(texts):
        return [None] * len(texts), f"{len(vectors)} vectors for {len(texts)} texts"
    return vectors, None


def embedding_counts(embedded: DataFrame, vector: str = "text_embedding") -> DataFrame:
    """Texts processed, vectors made and texts whose batch failed, as one row."""
    return embedded.agg(
        F.count(F.lit(1)).alias("texts"), F.count(vector).alias("vectors"), F.count(ERROR).alias("failed")
    )


def require_embedded(embedded: DataFrame, max_failed_share: float = 0.0) -> None:
    """Raise if more than this share of the texts has no vector because its batch failed."""
    texts, _, failed = embedding_counts(embedded).first()
    if failed > max_failed_share * texts:
        example = embedded.filter(F.col(ERROR).isNotNull()).select(ERROR).first()[0]
        raise RuntimeError(f"{failed} of {texts} texts were not embedded, such as by {example}")
