"""Line deduplication over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by line hash that says in how many documents of its batch a line was
found and which of them has the largest id. Each new batch is merge-anti-joined with the runs: lines that are
settled there, so that the batch can change nothing about them, are left out, and the rest becomes the batch's
own run. When a level has ``FANOUT`` runs they are merged into one of the next level, so there are at most
``FANOUT - 1`` runs a level and a line hash is rewritten once a level.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.binding import once
from trackweave.llm.common import HOT_SHARE, ascii_lower, join_hot, stored, working_folder

WHITE = " \t\n\x0b\x0c\r"
FANOUT = 4
BATCHES = 4
MIN_CHARS, MIN_DOCUMENTS = 20, 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(key: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(key.cast("binary"), 256)), 1, 16)


@dataclass
class LineRuns:
    """The levels of one store; ``add`` batches of ``(_line, _id)`` in any order."""

    spark: SparkSession
    buckets: int
    min_documents: int = MIN_DOCUMENTS
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    levels: list[list[str]] = field(default_factory=list)
    written: int = 0

    def __post_init__(self) -> None:
        self.database, self.folder = f"line_runs_{self.name}", working_folder(self.spark, "line-runs")
        self.spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.folder}'")

    def _write(self, rows: DataFrame, level: int) -> None:
        """``rows`` are dealt to the buckets already."""
        table = f"{self.database}.run_{level}_{self.written}"
        self.written += 1
        rows.write.format("parquet").bucketBy(self.buckets, "_line").sortBy("_line").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _runs(self) -> list[str]:
        return [table for level in self.levels for table in level]

    def add(self, lines: DataFrame) -> None:
        """One batch. A document must not be spread over batches; its repeated lines count once."""
        n_lines = lines.count()
        single = lines.groupBy("_line", "_id").agg(F.lit(1).alias("_one"))
        own = single.groupBy("_line").agg(F.count(F.lit(1)).alias("_documents"), F.max("_id").alias("_keep"))
        batch = own.repartition(self.buckets, "_line")
        for table in self._runs():
            run = self.spark.table(table).hint("merge").alias("run")
            batch = batch.alias("batch").join(run, self._settled(n_lines), "left_anti")
        self._write(batch, 0)
        self._compact()

    def _settled(self, n_lines: int) -> Column:
        """The run already says all: enough documents, a larger id, and not so frequent here that the
        count is needed to find the hot lines."""
        batch, run = (lambda c: F.col(f"batch.{c}")), (lambda c: F.col(f"run.{c}"))
        larger = F.coalesce(run("_keep") >= batch("_keep"), batch("_keep").isNull())
        rare = batch("_documents") <= F.lit(int(n_lines * HOT_SHARE))
        return (batch("_line") == run("_line")) & (run("_documents") >= self.min_documents) & larger & rare

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= FANOUT:
                self._merge(self.levels[level], level + 1)
                self.levels[level] = []
            level += 1

    def _merge(self, tables: list[str], level: int) -> None:
        self._write(self._merged(tables), level)
        for table in tables:
            # Superseded: its rows are in the merged run.
            self.spark.sql(f"DROP TABLE {table}")

    def _merged(self, tables: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed tables claims their buckets, which adaptive execution may have
        # given up, and then equal lines stay apart.
        schema = self.spark.table(tables[0]).schema
        folders = [f"{self.folder}/{table.split('.')[1]}" for table in tables]
        rows = self.spark.read.schema(schema).parquet(*folders)
        merged = rows.groupBy("_line").agg(F.sum("_documents").alias("_documents"), F.max("_keep").alias("_keep"))
        return merged.repartition(self.buckets, "_line")

    def frequent(self) -> DataFrame:
        """``_line, _documents, _keep`` of lines in enough documents. ``_documents`` counts every document for
        hot lines up to a thousandth of each batch's lines, and is at least ``min_documents`` for the others."""
        return self._merged(self._runs()).filter(F.col("_documents") >= self.min_documents)

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")


def _batch_of(rows: DataFrame, batches: int) -> Column:
    """Batch number by ranges of the id, the largest ids first."""
    cuts = rows.select(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    number = F.lit(batches - 1)
    for i, cut in enumerate(cuts or []):
        # Null ids are the smallest: they stay in the last batch.
        number = number - F.when(F.col("_id") > cut, 1).otherwise(0)
    return number


def drop_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
    buckets: int | None = None,
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: one row per row of ``docs``, its repeated lines removed.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in at least ``min_documents`` documents lose all their lines except in the largest id that holds them; the
    other lines stay as they were, joined by \\n. A null or empty text is one empty line. Rows with the same id
    are one document; null ids are one document with the smallest id. An empty table gives no rows; columns
    beyond id and text are not read.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), text.alias("_text"))
    # A row is known by its id and its text, so repeated rows may share what is found for them.
    rows = rows.withColumn("_content", F.xxhash64("_text"))
    long_enough = F.char_length(F.col("_key")) >= min_chars
    keys = F.transform(split_lines(ascii_lower(F.col("_text"))), lambda line: F.btrim(line, F.lit(WHITE)))
    found = rows.select("_id", "_content", F.posexplode(keys).alias("_at", "_key")).filter(long_enough)
    found = found.select("_id", "_content", "_at", line_hash(F.col("_key")).alias("_line"))
    batch = _batch_of(docs.select(F.col(id_column).alias("_id")), batches)
    # Sorted, so that a batch reads only its own pages.
    lines = stored(found.withColumn("_batch", batch).sortWithinPartitions("_batch"), "lines")
    runs = LineRuns(spark, buckets, min_documents)
    for number in range(batches):
        runs.add(lines.filter(F.col("_batch") == number).select("_line", "_id"))
    frequent = stored(runs.frequent(), "frequent-lines")
    runs.drop()
    met = join_hot(lines.drop("_batch"), frequent, ["_line"], "_documents", lines.count(), "inner")
    dropped = met.filter(~F.col("_id").eqNullSafe(F.col("_keep")))
    places = dropped.groupBy("_id", "_content").agg(F.sort_array(F.collect_set("_at")).alias("_places"))
    places = places.select(F.col("_id").alias("_own_id"), F.col("_content").alias("_own"), "_places")
    same = F.col("_id").eqNullSafe(F.col("_own_id")) & (F.col("_content") == F.col("_own"))
    joined = rows.join(places, same, "left")
    none = F.array().cast("array<int>")
    return joined.select(
        F.col("_id").alias(id_column),
        without_lines(F.col("_text"), F.coalesce("_places", none)).alias(text_column),
        F.size(split_lines(F.col("_text"))).cast("long").alias("n_lines"),
        F.size(F.coalesce("_places", none)).cast("long").alias("n_dropped"),
    )


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at ``places`` (sorted); the time is in proportion to its lines."""

    def cut(lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
        # What lies between one dropped line and the next.
        between = F.zip_with(
            F.slice(edges, 1, F.size(edges) - 1),
            F.slice(edges, 2, F.size(edges) - 1),
            lambda left, right: F.slice(lines, left + 2, right - left - 1),
        )
        return F.array_join(F.flatten(between), "\n")

    return F.when(F.size(places) == 0, text).otherwise(once(split_lines(text), cut))
