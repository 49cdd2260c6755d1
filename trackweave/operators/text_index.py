"""Stored index for finding rows by a part of a text: posting lists of two- and three-letter grams, sorted by gram.

A request reads the lists of a few rare grams of the text, not the catalogue: row groups without the gram are skipped by
their statistics. The rows that have all of them are then verified against the text itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Grams of a text that are looked up; more would cut the candidates little.
RARE_GRAMS = 3
# Candidates whose ids are pushed into the scan; more are joined.
PUSHED = 1000
# Rows of a file of the index; a file is what one task sorts.
FILE_ROWS = 2_000_000


def grams(text: Column, size: int) -> Column:
    """All stretches of ``size`` characters; none of a shorter text."""
    starts = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - (size - 1)))
    cut = F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
    return F.coalesce(cut, F.array().cast("array<string>"))


@dataclass
class TextIndex:
    """An index in a folder. ``order`` is the unique, non-null column that rows are listed by."""

    spark: SparkSession
    folder: str
    columns: tuple[str, ...]
    order: str

    def add(self, rows: DataFrame) -> None:
        """Append rows that the index does not have yet."""
        # Both forms of lower-casing agree but for few letters; the index has to hold what the search compares.
        texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in self.columns]
        own = F.array_distinct(F.concat(*[grams(text, size) for text in texts for size in (2, 3)]))
        postings = rows.select(F.explode(own).alias("gram"), F.col(self.order).alias("place"))
        parts = max(self.spark.sparkContext.defaultParallelism, math.ceil(rows.count() / FILE_ROWS))
        # A frequent gram's list goes over several files, since the place is part of the range.
        sorted_lists = postings.repartitionByRange(parts, "gram", "place").sortWithinPartitions("gram", "place")
        sorted_lists.write.mode("append").parquet(f"{self.folder}/postings")
        sorted_rows = rows.repartitionByRange(parts, self.order).sortWithinPartitions(self.order)
        sorted_rows.write.mode("append").parquet(f"{self.folder}/rows")
        counted = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{self.folder}/grams")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def candidates(self, text: str) -> DataFrame:
        """``place`` of the rows that have all rare grams of a lower-case text of two letters or more. Texts of
        two or three letters are grams themselves, so their candidates hold them for certain."""
        postings = self.spark.read.parquet(f"{self.folder}/postings")
        if len(text) <= 3:
            return postings.filter(F.col("gram") == text).select("place")
        own = sorted({text[i : i + 3] for i in range(len(text) - 2)})
        counts = self.spark.read.parquet(f"{self.folder}/grams").filter(F.col("gram").isin(own))
        # A row per gram of the text and run that was added.
        known = dict(counts.groupBy("gram").agg(F.sum("n")).collect())
        if len(known) < len(own):
            return postings.select("place").limit(0)
        rare = sorted(own, key=lambda gram: (known[gram], gram))[:RARE_GRAMS]
        hits = postings.filter(F.col("gram").isin(rare))
        return hits.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("place")

    def search(self, text: str, limit: int) -> DataFrame:
        """The first ``limit`` rows in order whose columns hold the text, ignoring case; texts of two letters or more."""
        lowered = text.lower()
        if len(lowered) < 2:
            raise ValueError("the text needs two letters at least")
        found, rows = self.candidates(lowered), self.rows()
        if len(lowered) <= 3:
            # Sorted and cut before any row is read.
            found = found.orderBy("place").limit(limit)
        few = [row[0] for row in found.limit(PUSHED + 1).collect()]
        if len(few) <= PUSHED:
            rows = rows.filter(F.col(self.order).isin(few)) if few else rows.limit(0)
        else:
            rows = rows.join(found.withColumnRenamed("place", "_place"), F.col(self.order) == F.col("_place")).drop("_place")
        holds = F.lit(False)
        for column in self.columns:
            holds = holds | F.coalesce(F.lower(F.col(column)).contains(lowered), F.lit(False))
        return rows.filter(holds).orderBy(self.order).limit(limit)


def build_text_index(
    catalogue: DataFrame, folder: str, columns: Sequence[str] = ("track_name", "artist_name"), order: str = "track_id"
) -> TextIndex:
    """Write an index of the catalogue into a new folder; all its columns are kept for results."""
    index = TextIndex(catalogue.sparkSession, folder, tuple(columns), order)
    index.add(catalogue)
    return index
