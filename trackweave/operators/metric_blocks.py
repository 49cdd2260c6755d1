"""All items in balls around centres, so that a query skips the balls that cannot hold one of its k best.

The centres are fitted on a bounded sample; every item belongs to its nearest one, whose ball is as wide as its farthest item. What
a query can score in a ball follows from the triangle inequality. Each query first meets the ball it lies in; its k-th
score there rules other balls out. Queries travel only to the balls left, items only once per block of queries, and nothing
that could be among the k best is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators import blocks
from trackweave.operators.ranking import top_n_per_group
from trackweave.session import materialize

CENTRES = 4096
CENTRE_ROWS = 512
# The sample that the centres are fitted on.
SAMPLE_PER_CENTRE = 16
SAMPLE_BYTES = 32 << 20
ROUNDS = 4
# Query by item pairs from which looking for balls to skip pays for the jobs it takes; both ways give the same rows.
WORTH_PAIRS = 40_000_000_000
# Sample points that try the balls, and the share of the sample in reach from which none of them is filled.
TRIALS = 256
HOPELESS = 0.8
# Distances or bounds of points to centres held at once inside a task, each in a few copies of 8 MB.
TILE_ENTRIES = 1 << 20
# Scores are rounded to twelve digits; a bound has to miss them by more.
SCORE_SLACK = 2e-12


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(lengths == 0, 1.0, lengths)[:, None]


def as_matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows."""
    if len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("all vectors must have the same dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def floor_of(metric: str, scores: np.ndarray) -> np.ndarray:
    """What a bound must reach to matter beside a k-th score; scores that are no numbers rule nothing out."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    slack = scores - SCORE_SLACK * np.maximum(1.0, np.abs(scores))
    if metric != "euclidean":
        return slack
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(slack > 0, -np.square(1 / np.maximum(slack, 1e-300) - 1), -np.inf)


class Balls:
    """Centres with the radius and number of the items around them; at most ``CENTRES``, so they travel to the tasks."""

    def __init__(self, metric: str, centres: np.ndarray):
        self.metric, self.centres = metric, centres
        self.radii = self.counts = None

    def points(self, column: pa.Array) -> np.ndarray:
        """Vectors as points between which distances decide: unit vectors for cosine."""
        matrix = as_matrix(column)
        if matrix.shape[1] != self.centres.shape[1]:
            raise ValueError("query and item vectors must have the same dimension")
        return unit_rows(matrix) if self.metric == "cosine" else matrix

    def squared_distances(self, points: np.ndarray) -> np.ndarray:
        own = np.einsum("ij,ij->i", points, points)[:, None]
        return own - 2 * points @ self.centres.T + np.einsum("ij,ij->i", self.centres, self.centres)[None, :]

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre (one that has items, once they are counted) and the exact distance to it."""
        nearest = np.empty(len(points), np.int32)
        step = max(1, TILE_ENTRIES // len(self.centres))
        for start in range(0, len(points), step):
            squared = self.squared_distances(points[start : start + step])
            if self.counts is not None:
                squared[:, self.counts == 0] = np.inf
            nearest[start : start + step] = np.argmin(squared, axis=1)
        gap = points - self.centres[nearest]
        return nearest, np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def highest(self, points: np.ndarray) -> np.ndarray:
        """The best score that each point can have in each ball, on the scale of ``floor_of``."""
        if self.metric == "dot":
            lengths = np.sqrt(np.einsum("ij,ij->i", points, points))
            product = points @ self.centres.T
            reach = lengths[:, None] * self.radii[None, :]
            return product + reach + 1e-9 * (1 + np.abs(product) + reach)
        squared = self.squared_distances(points)
        size = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", self.centres, self.centres)[None, :]
        # Less what rounding may have added.
        away = np.sqrt(np.maximum(0.0, squared - 1e-12 * size)) * (1 - 1e-9) - self.radii[None, :] * (1 + 1e-9)
        least = np.maximum(0.0, away) ** 2
        return 1 - least / 2 if self.metric == "cosine" else -least

    def floor_of(self, scores: np.ndarray) -> np.ndarray:
        return floor_of(self.metric, scores)


def fit_centres(
    items: DataFrame, metric: str, n_items: int, centres: int, hold_out: bool = False
) -> tuple[Balls, np.ndarray] | None:
    """Centres by a few rounds of k-means over a sample of at most ``SAMPLE_PER_CENTRE`` rows a centre and 32 MB, and
    its distinct points; with ``hold_out`` as many points again that the centres have not seen. None without a vector."""
    wanted = SAMPLE_PER_CENTRE * centres * (2 if hold_out else 1)
    share = min(1.0, 1.5 * wanted / max(1, n_items))
    sample = items.select("_vector").sample(share, seed=1).limit(wanted)
    size = sample.agg(F.max(F.size("_vector"))).first()[0] or 0
    sample = sample.limit(max(1, SAMPLE_BYTES // (8 * max(1, size)))).toArrow()
    if not sample.num_rows or not size:
        return None
    points = as_matrix(sample.column("_vector").combine_chunks())
    points = points[np.isfinite(points).all(axis=1)]
    if metric == "cosine":
        points = unit_rows(points)
    points = np.unique(points, axis=0) if len(points) else np.zeros((1, size))
    points, kept = (points[::2], points[1::2]) if hold_out and len(points) > 1 else (points, points)
    random = np.random.default_rng(1)
    balls = Balls(metric, points[np.sort(random.choice(len(points), min(centres, len(points)), replace=False))])
    for _ in range(ROUNDS if len(points) > len(balls.centres) else 0):
        nearest, _ = balls.place(points)
        sums, counts = np.zeros_like(balls.centres), np.bincount(nearest, minlength=len(balls.centres))
        np.add.at(sums, nearest, points)
        held = counts > 0
        balls.centres = np.where(held[:, None], sums / np.maximum(counts, 1)[:, None], balls.centres)
    return balls, kept


def nothing_to_skip(balls: Balls, points: np.ndarray) -> bool:
    """Whether hardly a ball is out of reach of some of the sample points, although the balls are taken no wider than the sample says
    and only the best score in it counts. Then placing all rows would not pay. A ball counts by its points."""
    trials = points[np.random.default_rng(3).permutation(len(points))[:TRIALS]]
    if len(points) < 2:
        return False
    guess = Balls(balls.metric, balls.centres)
    nearest, away = guess.place(points)
    guess.radii = np.zeros(len(balls.centres))
    np.maximum.at(guess.radii, nearest, away)
    product = trials @ points.T
    if balls.metric == "euclidean":
        squares = np.einsum("ij,ij->i", points, points)
        apart = np.einsum("ij,ij->i", trials, trials)[:, None] + squares[None, :] - 2 * product
        product = 1 / (1 + np.sqrt(np.maximum(0.0, apart)))
    # The best may be the point itself.
    second = np.partition(product, len(points) - 2, axis=1)[:, len(points) - 2]
    within = (guess.highest(trials) >= guess.floor_of(second)[:, None]).mean(axis=0)
    return bool(np.average(within, weights=np.bincount(nearest, minlength=len(within))) > HOPELESS)


def placed(rows: DataFrame, balls: Balls) -> DataFrame:
    """``rows`` with ``_centre`` and the distance to it, ``_away``."""
    schema = T.StructType([*rows.schema, T.StructField("_centre", T.IntegerType()), T.StructField("_away", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest, away = balls.place(balls.points(batch.column("_vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(away)], names=schema.names)

    return rows.mapInArrow(place, schema)


def in_reach(balls: Balls, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows, few at a time, with what they must reach by ``_floor`` and whether each ball that has items is in reach."""
    live = np.flatnonzero(balls.counts)
    step = max(1, TILE_ENTRIES // max(1, len(balls.centres)))
    for start in range(0, batch.num_rows, step):
        piece = batch.slice(start, step)
        floor = balls.floor_of(piece.column("_floor").to_numpy(zero_copy_only=False).astype(np.float64))
        # A bound that is no number rules nothing out.
        yield piece, floor, ~(balls.highest(balls.points(piece.column("_vector")))[:, live] < floor[:, None])


def count_balls(balls: Balls, items: DataFrame, block_rows: int) -> DataFrame:
    """Fill in radii and counts, a row a ball on the driver, and list the blocks."""
    stats = items.groupBy("_centre").agg(F.count(F.lit(1)), F.max("_away")).collect()
    balls.counts, balls.radii = np.zeros(len(balls.centres), np.int64), np.zeros(len(balls.centres))
    for centre, count, radius in stats:
        balls.counts[centre], balls.radii[centre] = count, radius
    return block_list(items.sparkSession, balls, block_rows)


def block_list(spark: SparkSession, balls: Balls, block_rows: int) -> DataFrame:
    """``_centre, _first, _parts``: the blocks of at most about ``block_rows`` rows of each ball."""
    parts = -(-balls.counts // block_rows)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    rows = [(int(c), int(first[c]), int(parts[c])) for c in range(len(parts)) if parts[c]]
    return F.broadcast(spark.createDataFrame(rows, "_centre int, _first long, _parts long"))


def meet(
    queries: DataFrame, items: DataFrame, query_key: Column | str, query_rows: int, cell: Callable[[pa.Table, pa.Table], pa.Table], schema
) -> tuple[DataFrame, int]:
    """``cell`` over all queries and items of one ``_block``, and how many cells there are. A block that more than
    ``query_rows`` queries want has several cells; items of unwanted blocks do not move."""
    wanted = queries.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("_cells"))
    wanted = materialize(wanted)
    cells = wanted.agg(F.sum("_cells")).first()[0] or 0
    number = F.pmod(F.xxhash64(query_key), F.col("_cells")).alias("_cell")
    left = queries.join(wanted, "_block").select(*queries.columns, number)
    right = items.join(wanted, "_block").select(*items.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1)).alias("_cell"))
    tasks = max(1, min(blocks.MAX_TASKS, 2 * cells))
    left, right = (side.repartition(tasks, "_block", "_cell") for side in (left, right))
    return left.groupBy("_block", "_cell").cogroup(right.groupBy("_block", "_cell")).applyInArrow(cell, schema), cells


def nearest_in_balls(
    queries: DataFrame, items: DataFrame, k: int, search, schema, query_id: str, item_id: str, n_items: int, query_rows: int, block_rows: int
) -> tuple[DataFrame, dict[str, int]] | None:
    """Candidates that hold the k best of every query, and the cells and copies it took; None where skipping does not pay.

    ``queries`` are stored. A floor that a query's own ball has set also spares candidates inside the other balls.
    """
    fitted = fit_centres(items, search.metric, n_items, min(CENTRES, max(1, math.ceil(n_items / min(CENTRE_ROWS, block_rows)))))
    if fitted is None:
        return None
    balls, points = fitted
    if nothing_to_skip(balls, points):
        return None
    items = materialize(placed(items, balls))
    parts = count_balls(balls, items, block_rows)
    spread = F.col("_first") + F.pmod(F.xxhash64(item_id, F.spark_partition_id()), F.col("_parts"))
    items = items.join(parts, "_centre").withColumn("_block", spread).drop("_centre", "_away", "_first", "_parts")
    numbered = queries.withColumn("_q", F.monotonically_increasing_id())
    own = F.col("_first") + F.pmod(F.xxhash64("_q"), F.col("_parts"))
    numbered = placed(numbered, balls).join(parts, "_centre").withColumn("_block", own)
    numbered = materialize(numbered.drop("_centre", "_away", "_first", "_parts"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search.run(left, [right])
        return search.nothing(left, right) if found is None else found

    home, home_cells = meet(numbered, items, "_q", query_rows, cell, schema)
    home = materialize(home)
    ranked = top_n_per_group(home, [query_id], [F.col("score").desc(), F.col(item_id)], k)
    floors = ranked.filter(F.col("rank") == k).select(F.col(query_id).alias("_of"), F.col("score").alias("_floor"))
    aware = numbered.join(floors, F.col(query_id) == F.col("_of"), "left").drop("_of")
    aware = aware.withColumnRenamed("_block", "_home")
    names = aware.columns
    live = np.flatnonzero(balls.counts)
    n_parts = -(-balls.counts // block_rows)
    out = T.StructType([*aware.schema, T.StructField("_balls", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All blocks in reach but the home block.
        copies = sum(int((inside @ n_parts[live]).sum()) - piece.num_rows for batch in batches for piece, _, inside in in_reach(balls, batch))
        yield pa.RecordBatch.from_arrays([pa.array([copies], pa.int64())], names=["copies"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, floor, inside in (found for batch in batches for found in in_reach(balls, batch)):
            rows, places = np.nonzero(inside)
            offsets = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(live[places].astype(np.int32)))
            columns = [pa.array(floor) if name == "_floor" else piece.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "_balls"])

    aware = materialize(aware)
    copies = aware.mapInArrow(count, "copies long").agg(F.sum("copies")).first()[0] or 0
    n_queries, n_blocks = numbered.count(), int(n_parts.sum())
    item_copies = n_items * math.ceil(copies / n_blocks / query_rows)
    every = n_queries * math.ceil(n_items / block_rows) + n_items * math.ceil(n_queries / query_rows)
    if copies + item_copies > every:
        return None
    # Written only if they are few.
    aware = materialize(aware.mapInArrow(reach, out))
    wide = aware.withColumn("_centre", F.explode("_balls")).drop("_balls").join(parts, "_centre")
    last = F.col("_first") + F.col("_parts") - 1
    wide = wide.withColumn("_block", F.explode(F.sequence("_first", last))).drop("_centre", "_first", "_parts")
    wide = wide.filter(F.col("_block") != F.col("_home")).drop("_home")
    rest, rest_cells = meet(wide, items, "_q", query_rows, cell, schema)
    told = {"balls": int((balls.counts > 0).sum()), "cells": home_cells + rest_cells, "copies": copies, "all": n_queries * n_blocks}
    return home.unionByName(rest), told
