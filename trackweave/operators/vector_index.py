"""Stored index for approximate nearest neighbours: coarse centres, posting lists as a partitioned table, exact scores.

Centres are fitted on a bounded sample; every vector is written to the list of its nearest centre, a folder of its own. A query
reads the lists of its nearest centres only, and scores their vectors exactly. How many lists that takes for the
wanted recall is measured on the sample when the index is built and stored with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.functions.vectors import METRICS
from trackweave.operators import blocks, metric_blocks
from trackweave.operators.metric_blocks import Balls
from trackweave.operators.neighbours import prepared
from trackweave.operators.ranking import top_n_per_group
from trackweave.session import materialize, ship_package

RECALL = 0.97
# Rows of one file of a list; a longer list has several.
FILE_ROWS = 500_000
# Sample rows that play queries when the number of lists is measured.
TRIALS = 256


@dataclass
class VectorIndex:
    """An index in a folder; small itself (at most 4,096 centres)."""

    spark: SparkSession
    folder: str
    balls: Balls
    probes: int

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists")

    def nearest(
        self,
        queries: DataFrame,
        k: int,
        probes: int | None = None,
        query_id: str = "query_id",
        query_vector: str = "vector",
        carry: Sequence[str] = (),
        carry_query: Sequence[str] = (),
        exclude: Sequence[tuple[str, str]] = (),
        query_rows: int = blocks.BROADCAST_ROWS,
        block_rows: int = blocks.CATALOGUE_BLOCK_ROWS,
    ) -> DataFrame:
        """``query_id, carry_query..., item id, carry..., score, rank``: k best rows of the ``probes`` nearest lists.

        Arguments as in ``neighbours.nearest``, scores are the same. With as many probes as lists the result is
        exact. Only lists that some query probes are read; long lists and lists that many queries probe are met in
        several tasks. Fewer than k rows come back where the lists hold fewer.
        """
        if k < 1:
            raise ValueError("k must be positive")
        ship_package(self.spark)
        balls, take = self.balls, min(len(self.balls.centres), probes or self.probes)
        item_id = self.lists().columns[0]
        queries, items, search, schema = prepared(
            queries, self.lists(), k, balls.metric, query_id, query_vector, item_id, "vector", carry, carry_query, exclude, ["_centre"]
        )
        names = queries.columns
        probing = T.StructType([*queries.schema, T.StructField("_balls", T.ArrayType(T.IntegerType()))])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    order = order_of_balls(balls, balls.points(batch.column("_vector")))[:, :take]
                    offsets = pa.array(range(0, order.size + 1, order.shape[1]), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(order.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "_balls"])

        asked = queries.mapInArrow(probe, probing).withColumn("_q", F.monotonically_increasing_id())
        asked = materialize(asked)
        wide = asked.withColumn("_centre", F.explode("_balls")).drop("_balls")
        # At most one number a list; as a partition filter it spares all other folders.
        wanted = sorted(row[0] for row in wide.select("_centre").distinct().collect())
        parts = metric_blocks.block_list(self.spark, balls, block_rows)
        last = F.col("_first") + F.col("_parts") - 1
        wide = wide.join(parts, "_centre").withColumn("_block", F.explode(F.sequence("_first", last)))
        wide = wide.drop("_centre", "_first", "_parts")
        spread = F.col("_first") + F.pmod(F.xxhash64(item_id, F.spark_partition_id()), F.col("_parts"))
        items = items.filter(F.col("_centre").isin(wanted)) if wanted else items.limit(0)
        items = items.join(parts, "_centre").withColumn("_block", spread).drop("_centre", "_first", "_parts")

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            found = search.run(left, [right])
            return search.nothing(left, right) if found is None else found

        partial, _ = metric_blocks.meet(wide, items, "_q", query_rows, cell, schema)
        return top_n_per_group(partial, [query_id], [F.col("score").desc(), F.col(item_id)], k)


def order_of_balls(balls: Balls, points: np.ndarray) -> np.ndarray:
    """Balls that hold rows, most promising first, per point."""
    live = np.flatnonzero(balls.counts) if balls.counts is not None else np.arange(len(balls.centres))
    if balls.metric == "dot":
        far = -(points @ balls.centres[live].T)
    else:
        far = balls.squared_distances(points)[:, live]
    return live[np.argsort(far, axis=1, kind="stable")]


def build_index(
    items: DataFrame,
    folder: str,
    k: int = 10,
    metric: str = "cosine",
    item_id: str = "track_id",
    vector: str = "vector",
    carry: Sequence[str] = (),
    lists: int | None = None,
    recall: float = RECALL,
) -> VectorIndex:
    """Write an index of all rows that have a vector into a new ``folder``; ``carry`` columns are kept for results.

    By default there are as many lists as the root of the number of rows, 4,096 at most. ``recall`` is that of the k best
    among sample points which the centres were not fitted on.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    ship_package(items.sparkSession)
    kept = [item_id, *[c for c in carry if c != item_id]]
    rows = items.filter(F.col(vector).isNotNull()).select(*kept, F.col(vector).alias("_vector"))
    n = items.count()
    fitted = metric_blocks.fit_centres(rows, metric, n, min(metric_blocks.CENTRES, lists or max(1, math.isqrt(n))), hold_out=True)
    if fitted is None:
        raise ValueError("an index needs at least one vector")
    balls, points = fitted
    # Lists side by side, a long one over many files, in the order of their centres.
    placed = metric_blocks.placed(rows, balls).withColumnRenamed("_vector", "vector")
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FILE_ROWS))
    dealt = placed.repartitionByRange(tasks, "_centre", F.xxhash64(item_id))
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_centre").parquet(f"{folder}/lists")
    written = items.sparkSession.read.parquet(f"{folder}/lists")
    metric_blocks.count_balls(balls, written, FILE_ROWS)
    probes = probes_for(balls, points, k, recall)
    centres = [
        (i, balls.centres[i].tolist(), float(balls.radii[i]), int(balls.counts[i]), metric, probes) for i in range(len(balls.centres))
    ]
    schema = "number int, centre array<double>, radius double, rows long, metric string, probes int"
    items.sparkSession.createDataFrame(centres, schema).coalesce(1).write.parquet(f"{folder}/centres")
    return VectorIndex(items.sparkSession, folder, balls, probes)


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    """An index that ``build_index`` has written."""
    rows = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r["number"])
    balls = Balls(rows[0]["metric"], np.array([r["centre"] for r in rows]))
    balls.radii, balls.counts = np.array([r["radius"] for r in rows]), np.array([r["rows"] for r in rows])
    return VectorIndex(spark, folder, balls, rows[0]["probes"])


def probes_for(balls: Balls, points: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that hold the share ``recall`` of the k best sample points of sample queries."""
    trials = points[np.random.default_rng(2).permutation(len(points))[:TRIALS]]
    if len(points) < 2:
        return 1
    home, _ = balls.place(points)
    if balls.metric == "euclidean":
        squares = np.einsum("ij,ij->i", points, points)
        scores = 2 * trials @ points.T - squares[None, :]
    else:
        scores = trials @ points.T
    # The trial itself is the first for cosine and distance; for products it may not be, which costs nothing.
    best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
    order = order_of_balls(balls, trials)
    place = np.empty((len(trials), len(balls.centres)), np.int64)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    reached = np.take_along_axis(place, home[best], axis=1)[:, 1:]
    needed = np.sort(reached.ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1
