"""The given tables seen as the tables of this library.

Column expressions are SQL text that Spark and DuckDB read alike, so that a query and the SQL it is
checked against start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.sources.tables import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, over all cores however few row groups they were written in."""
    return spread(table(spark, folder, "documents"))


CATALOGUE = {
    "track_id": "p_partkey",
    "track_name": "p_name",
    "artist_name": "p_brand",
    "album_name": "p_type",
    "popularity": "CAST(p_size * 2 AS DOUBLE)",
    "duration_ms": "CAST(p_size * 15000 AS DOUBLE)",
    "explicit": "(p_partkey % 20 = 0)",
    "release_date": "CAST(DATE '1985-01-01' + CAST((p_partkey % 2000) * 7 AS INT) AS STRING)",
}

# The same catalogue with missing, malformed and out-of-range values mixed in.
DIRTY = {
    **CATALOGUE,
    "popularity": """CASE WHEN p_partkey % 17 = 3 THEN NULL WHEN p_partkey % 19 = 4 THEN 'n/a'
        WHEN p_partkey % 23 = 5 THEN '-5' WHEN p_partkey % 29 = 6 THEN '120'
        WHEN p_partkey % 31 = 7 THEN ' 12 ' WHEN p_partkey % 37 = 8 THEN '1e1'
        ELSE CAST(p_size * 2 AS STRING) END""",
    "duration_ms": """CASE WHEN p_partkey % 41 = 9 THEN '3600001' WHEN p_partkey % 43 = 10 THEN NULL
        WHEN p_partkey % 47 = 11 THEN '3500000' ELSE CAST(p_size * 15000 AS STRING) END""",
    "lastfm_playcount": """CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'many'
        WHEN p_partkey % 11 = 0 THEN '-4' ELSE CAST(p_size * 100 AS STRING) END""",
}


def selected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def select_sql(columns: dict[str, str], source: str = "part") -> str:
    listed = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return f"SELECT {listed} FROM {source}"


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return selected(table(spark, folder, "part"), CATALOGUE)


def dirty_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return selected(table(spark, folder, "part"), DIRTY)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vector table with its label as artist."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("track_id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("track_name"),
        F.col("label").cast("string").alias("artist_name"),
        F.lit("embeddings").alias("album_name"),
        F.col("embedding").alias("combined_embedding"),
    )
