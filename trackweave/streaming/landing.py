"""Repeated landing runs as an incremental append, each landed file taken exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackweave.sources.records import flatten_records


def landed_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of JSON record files below a folder."""
    return spark.readStream.option("recursiveFileLookup", True).text(path).withColumnRenamed("value", "raw")


def append_landed(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Flatten what arrived since the last run and append it; the checkpoint remembers what was read."""
    rows = flatten_records(landed_lines(spark, path)).withColumn("loaded_at", F.current_timestamp())
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
