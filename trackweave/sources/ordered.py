"""Copies of a table in the order of a column, with the rows per file, so that a page anywhere reads one file or two."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a file: what a page sorts at most, but for a page that lies across two.
FILE_ROWS = 100_000


@dataclass
class OrderedCopy:
    spark: SparkSession
    folder: str
    order: str

    def manifest(self) -> list[tuple[str, int]]:
        """(path, rows) per file in the order of their contents: what the driver holds, a row per ``FILE_ROWS`` rows."""
        rows = self.spark.read.parquet(f"{self.folder}/manifest").orderBy("file").collect()
        return [(row["path"], row["rows"]) for row in rows]

    def page(self, offset: int = 0, limit: int = 50) -> DataFrame:
        """Rows ``offset .. offset + limit``; only files that hold some of them are read."""
        if not 1 <= limit <= 100:
            raise ValueError("limit must lie between 1 and 100")
        if offset < 0:
            raise ValueError("offset must not be negative")
        before, skipped, wanted = 0, 0, []
        for path, rows in self.manifest():
            if before + rows <= offset:
                skipped = before + rows
            elif before < offset + limit:
                wanted.append(path)
            before += rows
        table = self.spark.read.parquet(f"{self.folder}/rows")
        if not wanted:
            return table.limit(0)
        return self.spark.read.schema(table.schema).parquet(*wanted).orderBy(self.order).offset(offset - skipped).limit(limit)


def ordered_copy(df: DataFrame, folder: str, order: str) -> OrderedCopy:
    """Write ``df`` by ranges of ``order`` into a new folder: one scan for the ranges, one for the rows, whatever the values.

    Nulls come first. Equal values may lie in any order among themselves and may fill more than one file.
    """
    spark = df.sparkSession
    parts = max(1, math.ceil(df.count() / FILE_ROWS))
    dealt = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/rows")
    written = spark.read.parquet(f"{folder}/rows")
    lies = written.metadataColumn("_metadata")
    # Part files are numbered by range; counting rows reads the footers only.
    files = written.groupBy(lies["file_name"].alias("file"), lies["file_path"].alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    files.coalesce(1).write.parquet(f"{folder}/manifest")
    return OrderedCopy(spark, folder, order)
