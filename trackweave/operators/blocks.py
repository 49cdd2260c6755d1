"""Pairing a query set with a whole catalogue without a cross join.

A query set up to a checked bound travels to every task; the catalogue is scanned in place and never
shuffled. Beyond the bound both sides are cut into blocks of bounded size and every pair of blocks
meets in one cell, found by an equi-join on the cell's key.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from trackweave.session import materialize

# 4096 queries of 832 doubles are 27 MB.
BROADCAST_ROWS = 4096
BROADCAST_BYTES = 64 << 20
CATALOGUE_BLOCK_ROWS = 20_000
MAX_TASKS = 20_000
QUERY, ITEM = "_query_block", "_item_block"


def small_table(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> pa.Table | None:
    """The rows, if they fit both bounds; None otherwise. The frame is computed once and measured before any row moves."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return kept.toArrow() if _fits(kept, max_rows, max_bytes) else None
    finally:
        kept.unpersist()


def small_or_stored(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> tuple[pa.Table | None, DataFrame | None]:
    """The rows, if they fit both bounds; otherwise the frame as a checkpoint. Either way it is computed once."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if _fits(kept, max_rows, max_bytes):
            return kept.toArrow(), None
        return None, materialize(kept)
    finally:
        kept.unpersist()


def _fits(kept: DataFrame, max_rows: int, max_bytes: int) -> bool:
    arrays = [F.size(c) * 8 for c, kind in kept.dtypes if kind.startswith("array")]
    texts = [F.octet_length(c) for c, kind in kept.dtypes if kind == "string"]
    row_bytes = F.lit(8 * len(kept.columns))
    for part in arrays + texts:
        row_bytes = row_bytes + F.coalesce(part, F.lit(0))
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def even_block(key: Column, blocks: int) -> Column:
    """Block number that spreads rows evenly, a key that fills a third of the table included.

    The partition number splits equal keys and does not change when a lost task runs again.
    """
    return F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(blocks)).cast("int")


def fragment_replicate(
    queries: DataFrame,
    items: DataFrame,
    query_key: str,
    item_key: str,
    n_items: int,
    query_rows: int = BROADCAST_ROWS,
    item_rows: int = CATALOGUE_BLOCK_ROWS,
):
    """Cogroup of all (query block, item block) cells; ``n_items`` may be an upper bound."""
    query_blocks = max(1, math.ceil(queries.count() / query_rows))
    # Small tables are cut further, so that every core finds a cell.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    item_blocks = max(1, math.ceil(n_items / item_rows), math.ceil(2 * cores / query_blocks))

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = queries.withColumn(QUERY, even_block(F.col(query_key), query_blocks)).withColumn(ITEM, every(item_blocks))
    right = items.withColumn(ITEM, even_block(F.col(item_key), item_blocks)).withColumn(QUERY, every(query_blocks))
    # A stated number of partitions, some more than cells: adaptive execution would merge cells that
    # are small in bytes but long in work.
    tasks = min(MAX_TASKS, 2 * query_blocks * item_blocks)
    left, right = (side.repartition(tasks, QUERY, ITEM) for side in (left, right))
    return left.groupBy(QUERY, ITEM).cogroup(right.groupBy(QUERY, ITEM))
