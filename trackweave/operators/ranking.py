"""Ordering operators: first-per-key, quota union, top-n per group, paging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators.order_stats import value_at_rank

PLAIN_OFFSET = 10_000


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of every group, with their rank.

    Up to the session's group-limit threshold Catalyst cuts each map partition to ``n`` rows per
    group before the shuffle (WindowGroupLimit), so a group holding a third of all rows arrives as
    ``n`` rows per map task. Beyond it, a salted first round spreads a hot group over many tasks.
    """
    if n >= _group_limit(df.sparkSession):
        # One salt a partition, so there are the more of them the larger the table is.
        salted = df.withColumn("_salt", F.spark_partition_id())
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n).drop("_n", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order (``dropDuplicates`` keeps an arbitrary one)."""
    return top_n_per_group(df, keys, order, 1, "_first").drop("_first")


def union_sources(sources: Sequence[DataFrame], quota: int | None, order: str) -> DataFrame:
    """Concatenate result lists, at most ``quota`` rows from each, remembering list and position.

    Without a quota all rows come and the position is the value of the order column.
    """
    numbered = [frame.withColumn("source_order", F.lit(place)) for place, frame in enumerate(sources)]
    merged = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), numbered)
    if quota is None:
        return merged.withColumn("position", F.col(order))
    return take_quota(merged, "source_order", quota, order)


def take_quota(df: DataFrame, source: str, quota: int, order: str) -> DataFrame:
    """At most ``quota`` rows per source; the place within the source goes to ``position``.

    Quotas beyond Catalyst's limit for cutting map partitions are cut there by heaps of ``quota`` rows per source, so
    the shuffle moves at most quota rows per source and partition, whatever the size of the table.
    """
    plain = not any(isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) for c in (source, order))
    if quota >= _group_limit(df.sparkSession) and plain:
        df = _first_per_partition(df, source, order, quota)
    window = Window.partitionBy(source).orderBy(F.col(order))
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= quota)


def _group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def _first_per_partition(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Of every partition the first ``n`` rows of each group. A task holds those and one batch.

    Null orders come first and NaN last, as in Spark; the two flags say so to Arrow, whose order of them differs.
    """
    flags = {"_present": F.col(order).isNotNull(), "_nan": F.lit(False)}
    if df.schema[order].dataType.typeName() in ("float", "double"):
        flags["_nan"] = F.coalesce(F.isnan(order), F.lit(False))
    flagged = df.withColumns(flags)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = None, [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            # Sorting again only when as many rows have come as are held.
            if rows >= max(n, 0 if held is None else held.num_rows):
                held, waiting, rows = first(held, waiting), [], 0
        if waiting:
            held = first(held, waiting)
        if held is not None:
            yield from held.select(names).to_batches()

    def first(held: pa.Table | None, batches: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(batches)
        table = table if held is None else pa.concat_tables([held, table])
        groups = table.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices
        keyed = table.append_column("_group", groups)
        keyed = keyed.sort_by([("_group", "ascending"), ("_present", "ascending"), ("_nan", "ascending"), (order, "ascending")])
        group_of = keyed.column("_group").to_numpy()
        place = np.arange(len(group_of)) - np.searchsorted(group_of, group_of)
        return keyed.take(pa.array(np.flatnonzero(place < n))).drop_columns("_group")

    names = df.columns
    return flagged.mapInArrow(cut, df.schema)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows ``offset .. offset + limit`` by a unique numeric or string order column.

    A plain offset makes Spark keep ``offset + limit`` rows in one place, so deep pages start at the exact
    order statistic of a numeric order column, or at the prefix of a string one, and keep few rows before their own.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    numeric = df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")
    if offset <= PLAIN_OFFSET:
        return df.orderBy(order).offset(offset).limit(limit)
    if not numeric:
        prefix, before = _prefix_at(df, order, offset)
        rest = df if prefix is None else df.filter(F.col(order) >= prefix)
        return rest.orderBy(order).offset(offset - before).limit(limit)
    start = value_at_rank(df, order, offset)
    if start is None:
        return df.limit(0)
    before = df.filter(F.col(order) < start).count()
    return df.filter(F.col(order) >= start).orderBy(order).offset(offset - before).limit(limit)


def _prefix_at(df: DataFrame, order: str, offset: int) -> tuple[str | None, int]:
    """A prefix that at most ``PLAIN_OFFSET`` rows or equal strings have, and how many rows come before it.

    Every round counts the rows by one character more; the driver sees a row per character that follows.
    """
    prefix, before, kind = "", df.filter(F.col(order).isNull()).count(), df.schema[order].dataType.typeName()
    if kind != "string" or offset < before:
        return None, 0
    while True:
        inside = df.filter(F.col(order).startswith(prefix))
        counts = inside.groupBy(F.substring(F.col(order), 1, len(prefix) + 1).alias("p")).count().collect()
        for row in sorted(counts, key=lambda r: r["p"].encode()):
            if before + row["count"] > offset:
                break
            before += row["count"]
        else:
            return prefix, before - sum(r["count"] for r in counts)
        # Rows that are the prefix itself are equal.
        if row["count"] <= PLAIN_OFFSET or row["p"] == prefix:
            return row["p"], before
        prefix = row["p"]


def with_total(rows: DataFrame, table: DataFrame, name: str = "total") -> DataFrame:
    """Attach the row count of the whole table; an uncorrelated scalar subquery, not a join."""
    return rows.withColumn(name, table.agg(F.count(F.lit(1)).alias(name)).scalar())


def page_number(rank: Column, size: int = 6) -> Column:
    return F.ceil(rank / F.lit(float(size))).cast("int")
