"""Exact top-k neighbours of many query vectors in a catalogue of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.functions.vectors import METRICS, as_vector
from trackweave.operators import blocks, metric_blocks
from trackweave.operators.ranking import top_n_per_group
from trackweave.operators.running_best import BLOCK_QUERIES, FOUND, TIE_DIGITS, NumberedSearch, scanned, streamed
from trackweave.session import materialize, ship_package

# Score matrix entries held at once inside a task (32 MB).
MATRIX_ENTRIES = 4_000_000


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    metric: str = "cosine",
    query_id: str = "query_id",
    query_vector: str = "vector",
    item_id: str = "track_id",
    item_vector: str = "vector",
    carry: Sequence[str] = (),
    carry_query: Sequence[str] = (),
    exclude: Sequence[tuple[str, str]] = (),
    broadcast_rows: int = blocks.BROADCAST_ROWS,
    block_rows: int = blocks.CATALOGUE_BLOCK_ROWS,
) -> DataFrame:
    """``query_id, carry_query..., item_id, carry..., score, rank``: k best items per query, ties by id.

    ``exclude`` lists (query column, item column) pairs; an item is no candidate for a query when a
    pair is equal. Rows without a vector take no part. Each task keeps k rows per query, whatever the
    number of items it reads, so the shuffle moves k rows per query and task. Many queries against many items skip the
    parts of the catalogue that cannot hold one of their k best; the rows are the same either way.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    if k < 1:
        raise ValueError("k must be positive")
    raw = [side.schema[name].dataType for side, name in ((queries, query_vector), (items, item_vector))]
    queries, items, search, schema = prepared(
        queries, items, k, metric, query_id, query_vector, item_id, item_vector, carry, carry_query, exclude
    )

    ship_package(queries.sparkSession)
    small, queries = blocks.small_or_stored(queries, broadcast_rows)
    if small is not None:
        shared = items.sparkSession.sparkContext.broadcast(small)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = search.run(shared.value, (pa.Table.from_batches([batch]) for batch in batches))
            if found is not None:
                yield from found.to_batches()

        partial = items.mapInArrow(scan, schema)
    else:
        # The same vectors in half the bytes.
        if raw[0] == raw[1] == T.ArrayType(T.FloatType()):
            queries = queries.withColumn("_vector", F.col("_vector").cast("array<float>"))
        else:
            items = items.withColumn("_vector", as_vector(F.col("_vector")))
        partial = _by_distinct_vectors(queries, items, search, broadcast_rows, block_rows)
    order = [F.col("score").desc(), F.col(item_id)]
    return top_n_per_group(partial, [query_id], order, k)


def _by_distinct_vectors(queries: DataFrame, items: DataFrame, search: _Search, query_rows: int, block_rows: int) -> DataFrame:
    """The k best of every query, found once for all queries that are alike, among items one for each distinct vector.

    An item class is a vector with the values that exclude it, in the order of its first id; it stands for its first rows. Where
    an id excludes a query's own rows, as many further classes and rows are kept as an id has rows at most, so k remain.
    """
    k, metric, item_id, out = search.k, search.metric, search.item_id, search.out
    items = materialize(items)
    own, labels, spare = [pair for pair in search.exclude if pair[1] == item_id], [pair for pair in search.exclude if pair[1] != item_id], 0
    if own:
        most = items.filter(F.col(item_id).isNotNull()).groupBy(item_id).count().agg(F.max("count")).first()[0] or 0
        spare = most * len(own)
        if spare > k:
            own, labels, spare = [], list(search.exclude), 0
    wanted = k + spare

    kinds = list(dict.fromkeys(["_vector", *[right for _, right in labels]]))
    # Rows are sorted by a number first, since comparing vectors is slow.
    kept = top_n_per_group(items.withColumn("_hash", F.xxhash64(*kinds)), ["_hash", *kinds], [F.col(item_id)], wanted, "_place")
    kept = materialize(kept.drop("_hash"))
    parts = min(blocks.MAX_TASKS, max(2 * items.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // block_rows)))
    firsts = kept.filter(F.col("_place") == 1).repartitionByRange(parts, item_id).sortWithinPartitions(item_id)
    # Numbers that ascend like the first ids, so that ties go by them.
    firsts = materialize(firsts.withColumn("_item", F.monotonically_increasing_id()))
    named = firsts.select("_item", *[F.col(c).alias(f"_kind{i}") for i, c in enumerate(kinds)])
    others = _with_kind(kept.filter(F.col("_place") > 1), named, kinds)
    members = firsts.select("_item", *out).unionByName(others.select("_item", *out))

    alike = list(dict.fromkeys(["_vector", *[left for left, _ in labels]]))
    # Without a few rows in each of very many partitions, which would all write to all others.
    queries = queries.coalesce(max(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // block_rows)))
    asked = materialize(queries.select(*alike).distinct().withColumn("_asked", F.monotonically_increasing_id()))
    renamed = asked.select("_asked", *[F.col(c).alias(f"_kind{i}") for i, c in enumerate(alike)])
    asking = _with_kind(queries, renamed, alike).select("_asked", *dict.fromkeys([*search.query_out, *[left for left, _ in own]]))

    found = _numbered(asked, firsts.select("_item", *kinds), NumberedSearch(wanted, metric, labels), query_rows, block_rows)
    best = top_n_per_group(found, ["_asked"], [F.col("score").desc(), F.col("_item")], wanted, "_place").drop("_place")
    rows = best.join(members, "_item")
    rows = top_n_per_group(rows, ["_asked"], [F.col("score").desc(), F.col(item_id)], wanted, "_place")
    listed = F.collect_list(F.struct("_place", "score", *out))
    lists = rows.groupBy("_asked").agg(F.array_sort(listed, lambda a, b: a["_place"] - b["_place"]).alias("_list"))
    answers = asking.join(lists, "_asked")
    for left, right in own:
        apart = lambda row: F.coalesce(row[right] != F.col(left), F.lit(True))  # noqa: B023, E731
        answers = answers.withColumn("_list", F.filter("_list", apart))
    answers = answers.select(*search.query_out, F.explode(F.slice("_list", 1, k)).alias("_row"))
    return answers.select(*search.query_out, *[F.col(f"_row.{c}").alias(c) for c in [*out, "score"]])


def _with_kind(rows: DataFrame, numbered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the number of their kind; null values are alike too. A number of each kind is compared before the vectors are."""
    rows = rows.withColumn("_hash", F.xxhash64(*columns))
    numbered = numbered.withColumn("_kind", F.xxhash64(*[f"_kind{i}" for i in range(len(columns))]))
    alike = [F.col(c).eqNullSafe(F.col(f"_kind{i}")) for i, c in enumerate(columns)]
    return rows.join(numbered, reduce(and_, [F.col("_hash") == F.col("_kind"), *alike]))


def _numbered(asked: DataFrame, items: DataFrame, search: NumberedSearch, query_rows: int, block_rows: int) -> DataFrame:
    """``_asked, _item, score``: candidates that hold the best of every ``_asked``."""
    few = blocks.small_table(asked, query_rows)
    if few is not None:
        return scanned(items.sparkSession.sparkContext.broadcast(few), items, search)
    n_asked, n_items = asked.count(), items.count()
    if n_asked * n_items >= metric_blocks.WORTH_PAIRS:
        found = metric_blocks.nearest_in_balls(asked, items, search.k, search, FOUND, "_asked", "_item", n_items, query_rows, block_rows)
        if found:
            return found[0]
    return streamed(asked, items, search, n_asked, n_items, min(BLOCK_QUERIES, 4 * query_rows))


def prepared(queries, items, k, metric, query_id, query_vector, item_id, item_vector, carry, carry_query, exclude, keep=()):
    """Both sides cut to the columns that matter (``keep`` of the items too), the vector as ``_vector``; what a task does; what it returns."""
    query_out = [query_id, *[c for c in carry_query if c != query_id]]
    query_columns = list(dict.fromkeys([*query_out, *[left for left, _ in exclude]]))
    item_columns = list(dict.fromkeys([item_id, *carry, *[right for _, right in exclude]]))
    queries = queries.filter(F.col(query_vector).isNotNull()).select(
        *query_columns, as_vector(F.col(query_vector)).alias("_vector")
    )
    items = items.filter(F.col(item_vector).isNotNull()).select(*item_columns, *keep, F.col(item_vector).alias("_vector"))
    out = [item_id, *[c for c in carry if c != item_id]]
    schema = T.StructType(
        [T.StructField(c, queries.schema[c].dataType) for c in query_out]
        + [T.StructField(c, items.schema[c].dataType) for c in out]
        + [T.StructField("score", T.DoubleType())]
    )
    return queries, items, _Search(k, metric, query_out, item_id, out, tuple(exclude)), schema


class _Search:
    """Task-side helper: block-wise products, then exact scores for the few rows that may win."""

    def __init__(self, k, metric, query_out, item_id, out, exclude):
        self.k, self.metric, self.exclude = k, metric, exclude
        self.query_out, self.item_id, self.out = query_out, item_id, out

    def run(self, queries: pa.Table, chunks) -> pa.Table | None:
        if not queries.num_rows:
            return None
        q = self._matrix(queries)
        best, floor = None, np.full(len(q), -np.inf)
        if "_floor" in queries.column_names:
            # Known from elsewhere; it has its slack already.
            floor = queries.column("_floor").to_numpy().copy()
        step = max(1, MATRIX_ENTRIES // len(q))
        for chunk in chunks:
            for start in range(0, chunk.num_rows, step):
                best, floor = self._add(queries, q, chunk.slice(start, step), best, floor)
        if best is None:
            return None
        asked = queries.select(self.query_out).take(best.column("_q"))
        found = best.select([*self.out, "score"])
        return pa.table([*asked.columns, *found.columns], names=[*self.query_out, *found.column_names])

    def nothing(self, queries: pa.Table, items: pa.Table) -> pa.Table:
        columns = [queries.column(c).slice(0, 0) for c in self.query_out]
        columns += [items.column(c).slice(0, 0) for c in self.out]
        return pa.table([*columns, pa.array([], pa.float64())], names=[*self.query_out, *self.out, "score"])

    def _matrix(self, table: pa.Table) -> np.ndarray:
        column = table.column("_vector").combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        if values.size % max(1, len(column)) or len(pc.unique(pc.list_value_length(column))) > 1:
            raise ValueError("all vectors must have the same dimension")
        matrix = values.reshape(len(column), -1)
        if self.metric == "cosine":
            lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            matrix = matrix / np.where(lengths == 0, 1.0, lengths)[:, None]
        return matrix

    def _rough(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Matrix product that orders like the metric (negative squared distance for euclidean)."""
        product = q @ v.T
        if self.metric != "euclidean":
            return product
        return 2 * product - np.einsum("ij,ij->i", q, q)[:, None] - np.einsum("ij,ij->i", v, v)[None, :]

    def _exact(self, q: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The same for single pairs, summed in an order that does not depend on the block."""
        result = np.empty(len(rows))
        step = max(1, MATRIX_ENTRIES // q.shape[1])
        for start in range(0, len(rows), step):
            left, right = q[rows[start : start + step]], v[cols[start : start + step]]
            if self.metric == "euclidean":
                gap = left - right
                result[start : start + step] = -np.einsum("ij,ij->i", gap, gap)
            else:
                result[start : start + step] = np.einsum("ij,ij->i", left, right)
        return result

    def _mask_excluded(self, queries: pa.Table, chunk: pa.Table, scores: np.ndarray) -> None:
        for left, right in self.exclude:
            known = pc.unique(queries.column(left).drop_null())
            mine = pc.index_in(queries.column(left), value_set=known).fill_null(-1).to_numpy()
            other = chunk.column(right).cast(known.type)
            theirs = pc.index_in(other, value_set=known, skip_nulls=True).fill_null(-1).to_numpy()
            columns = np.flatnonzero(theirs >= 0)
            same = mine[:, None] == theirs[None, columns]
            block = scores[:, columns]
            block[same] = -np.inf
            scores[:, columns] = block

    def _add(self, queries, q, chunk, best, floor):
        v = self._matrix(chunk)
        if v.shape[1] != q.shape[1]:
            raise ValueError("query and item vectors must have the same dimension")
        scores = self._rough(q, v)
        magnitude = np.abs(scores).max()
        self._mask_excluded(queries, chunk, scores)
        slack = 1e-9 * max(1.0, magnitude)
        likely = scores >= (floor - slack)[:, None]
        if likely.sum() > 4 * self.k * len(q) and scores.shape[1] > self.k:
            cut = scores.shape[1] - self.k
            floor_here = np.partition(scores, cut, axis=1)[:, cut]
            likely &= scores >= (floor_here - slack)[:, None]
        rows, cols = np.nonzero(likely & (scores > -np.inf))
        if not len(rows):
            return best, floor
        inner = self._exact(q, v, rows, cols)
        final = 1.0 / (1.0 + np.sqrt(-inner)) if self.metric == "euclidean" else inner
        score = np.round(final, TIE_DIGITS)
        if len(rows) > self.k * len(q):
            # However many tie, no more than k a query are copied.
            by_id = np.empty(chunk.num_rows, np.int64)
            by_id[pc.sort_indices(chunk, sort_keys=[(self.item_id, "ascending")]).to_numpy()] = np.arange(chunk.num_rows)
            order = np.lexsort((by_id[cols], -score, rows))
            rows = rows[order]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
            order, rows = order[first], rows[first]
            cols, inner, score = cols[order], inner[order], score[order]
        found = chunk.select(self.out).take(pa.array(cols))
        found = found.append_column("_q", pa.array(rows))
        found = found.append_column("_inner", pa.array(inner))
        found = found.append_column("score", pa.array(score))
        pool = found if best is None else pa.concat_tables([best, found])
        pool = pool.sort_by([("_q", "ascending"), ("score", "descending"), (self.item_id, "ascending")])
        group = pool.column("_q").to_numpy()
        place = np.arange(len(group)) - np.searchsorted(group, group)
        best = pool.take(pa.array(np.flatnonzero(place < self.k)))
        place, group = place[place < self.k], group[place < self.k]
        full = place == self.k - 1
        floor = floor.copy()
        floor[group[full]] = np.maximum(floor[group[full]], best.column("_inner").to_numpy()[full])
        return best, floor
