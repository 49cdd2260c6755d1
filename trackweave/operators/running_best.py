"""The k best items of a block of queries while the items stream by.

Rough products in single precision only propose pairs: the bound on their error is taken off the score that a pair must
reach, and what is proposed is summed again in double precision, pair by pair. A task holds its queries, their k best and
one tile of products, however many items it reads and however many of them tie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators import blocks
from trackweave.operators.metric_blocks import floor_of, unit_rows

# Scores closer than this are ties and ordered by id; well above the noise of double arithmetic.
TIE_DIGITS = 12
# Products held at once inside a task (4 MB), of so many queries with a piece of the items. Nearly square tiles read each vector for many products.
TILE_ENTRIES = 1 << 20
TILE_QUERIES = 1024
GROUP_ITEMS = 32
# The first items, whose products tell what the k best must reach before a pair is looked at.
SEED_ITEMS = 2048
# Numbers gathered at once for exact scores (512 KB a side).
EXACT_ENTRIES = 1 << 16
# Items that a task should at least have, since the first of them propose the most pairs.
PART_ITEMS = 50_000
# Queries of a block, unless their vectors need more than the bytes.
BLOCK_QUERIES = 16_384
BLOCK_BYTES = 16 << 20
NO_ITEM = np.iinfo(np.int64).max
FOUND = T.StructType([T.StructField("_asked", T.LongType()), T.StructField("_item", T.LongType()), T.StructField("score", T.DoubleType())])


def matrix_of(column: pa.Array | pa.ChunkedArray, metric: str) -> np.ndarray:
    """Vectors as rows of doubles, as unit vectors for cosine."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if values.size % max(1, len(column)) or len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("all vectors must have the same dimension")
    matrix = values.reshape(len(column), -1)
    with np.errstate(all="ignore"):
        return unit_rows(matrix) if metric == "cosine" else matrix


class RunningBest:
    """Items and queries are numbers; of equal scores the smaller item number comes first."""

    def __init__(self, k: int, metric: str, numbers: np.ndarray, matrix: np.ndarray, labels: Sequence[pa.Array], floor: np.ndarray | None = None):
        self.k, self.metric, self.numbers, self.q = k, metric, numbers, matrix
        self.known = [pc.unique(own.drop_null()) for own in labels]
        self.codes = [self._codes(own, known) for own, known in zip(labels, self.known)]
        n = len(matrix)
        self.scores, self.items = np.full((n, k), -np.inf), np.full((n, k), NO_ITEM)
        self.least = np.full(n, -np.inf) if floor is None else floor.copy()
        self.is_odd = ~np.isfinite(matrix).all(axis=1)
        finite = matrix[~self.is_odd]
        # Differences do not change with the origin, and near it single precision tells more of them apart.
        self.origin = finite.mean(axis=0) if metric == "euclidean" and len(finite) else np.zeros(matrix.shape[1])
        self.rough = {np.float64: self._widened(matrix, np.ones(n))}
        self.rough[np.float32] = self.rough[np.float64].astype(np.float32)
        self.lengths = self._lengths(self.rough[np.float64])
        self.lengths[self.is_odd] = 0
        moved = self.rough[np.float64][:, :-1]
        with np.errstate(all="ignore"):
            self.squares = np.einsum("ij,ij->i", moved, moved) if metric == "euclidean" else np.zeros(n)
        self.squares[self.is_odd] = 0
        self.step = max(1, TILE_ENTRIES // max(1, min(n, TILE_QUERIES)))
        self.waiting, self.n_waiting = [], 0
        self.tile, self.seeds = {}, SEED_ITEMS
        # A tile is no longer than what came before it, so that not too many pairs are proposed against an early floor.
        self.longest_tile = self.step if floor is not None else 2 * k

    @staticmethod
    def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
        found = pc.index_in(values.cast(known.type), value_set=known, skip_nulls=True)
        return found.fill_null(-1).to_numpy(zero_copy_only=False)

    @staticmethod
    def _lengths(matrix: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(np.einsum("ij,ij->i", matrix, matrix))

    def _widened(self, matrix: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """For distances one more column, so that the product orders like the negative distance."""
        if self.metric != "euclidean":
            return matrix
        moved = matrix - self.origin
        if last is None:
            with np.errstate(all="ignore"):
                last = -np.einsum("ij,ij->i", moved, moved) / 2
        return np.column_stack([moved, last])

    def add(self, numbers: np.ndarray, v: np.ndarray, labels: Sequence[pa.Array]) -> None:
        if not len(v) or not len(self.q):
            return
        if v.shape[1] != self.q.shape[1]:
            raise ValueError("query and item vectors must have the same dimension")
        codes = [self._codes(own, known) for own, known in zip(labels, self.known)]
        wide = self._widened(v)
        fine = np.isfinite(wide).all(axis=1)
        if not fine.all():
            # No product tells anything about these, so all their scores are exact.
            for i in np.flatnonzero(~fine):
                self._propose(np.arange(len(self.q)), np.full(len(self.q), i), numbers, v, codes)
            numbers, v, wide, codes = numbers[fine], v[fine], wide[fine], [c[fine] for c in codes]
            if not len(v):
                return
        longest = float(self._lengths(wide).max())
        plain = max(longest, float(self.lengths.max())) < 1e15
        rough = wide.astype(np.float32) if plain else wide
        start = 0
        if self.seeds > 0:
            self._seed(rough[: self.seeds], longest, codes)
            self.seeds -= len(v)
        while start < len(v):
            early = self.longest_tile < self.step
            stop = start + min(self.step, self.longest_tile)
            for first in range(0, len(self.q), TILE_QUERIES):
                piece = slice(first, first + TILE_QUERIES)
                self._tile(piece, numbers[start:stop], v[start:stop], rough[start:stop], wide[start:stop], longest, [c[start:stop] for c in codes])
                if self.n_waiting >= max(1024, len(self.q) // 2):
                    self._merge()
            start = stop
            if early:
                self._merge()
                self.longest_tile *= 2

    def _product(self, piece: slice, rough: np.ndarray, rows: int) -> np.ndarray:
        """Products, a row for each item, in memory that the next call uses again; further rows up to ``rows`` are no candidates."""
        kind, queries = rough.dtype.type, self.rough[rough.dtype.type][piece]
        if kind not in self.tile or self.tile[kind].size < rows * len(queries):
            self.tile[kind] = np.empty(rows * len(queries), kind)
        product = self.tile[kind][: rows * len(queries)].reshape(rows, len(queries))
        product[len(rough) :] = -np.inf
        with np.errstate(all="ignore"):
            np.matmul(rough, queries.T, out=product[: len(rough)])
        return product

    def _slack(self, piece: slice, rough: np.ndarray, longest: float) -> np.ndarray:
        """How far a product may be from the exact one."""
        width, lengths = rough.shape[1], self.lengths[piece]
        return (width + 8) * np.finfo(rough.dtype).eps * lengths * longest + 2e-38 * width * (1 + lengths + longest)

    def _seed(self, rough: np.ndarray, longest: float, codes: Sequence[np.ndarray]) -> None:
        """What the k best must reach, from a few items: k groups of them hold one that is at least the k-th largest of their maxima."""
        size = max(1, len(rough) // (4 * self.k))
        groups = len(rough) // size
        if groups < self.k:
            return
        rough = rough[: groups * size]
        queries = max(1, min(TILE_QUERIES, TILE_ENTRIES // len(rough)))
        for first in range(0, len(self.q), queries):
            piece = slice(first, first + queries)
            product = self._product(piece, rough, len(rough))
            for own, other in zip(self.codes, codes):
                other = other[: len(rough), None]
                product[(other >= 0) & (other == own[None, piece])] = -np.inf
            with np.errstate(all="ignore"):
                highest = product.reshape(groups, size, -1).max(axis=1)
                reached = np.partition(highest, groups - self.k, axis=0)[groups - self.k].astype(np.float64)
                reached[np.isnan(highest).any(axis=0) | self.is_odd[piece]] = -np.inf
                reached -= self._slack(piece, rough, longest)
                if self.metric == "euclidean":
                    squares = self.squares[piece]
                    apart = squares - 2 * reached + 1e-15 * (squares + np.abs(reached))
                    reached = 1 / (1 + np.sqrt(np.maximum(0.0, apart)))
                self.least[piece] = np.maximum(self.least[piece], floor_of(self.metric, reached))

    def _likely(self, piece: slice, rough: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """Items, and queries of the piece, of the pairs whose product may reach what matters."""
        kind, n, slack = rough.dtype.type, len(rough), self._slack(piece, rough, longest)
        wanted = self.least[piece]
        if self.metric == "euclidean":
            slack += 1e-15 * (self.squares[piece] + np.abs(wanted))
            wanted = (wanted + self.squares[piece]) / 2
        bound = wanted - slack
        if kind is np.float32:
            # Beyond any product, and within the type.
            bound = np.clip(bound, -3e38, 3e38).astype(np.float32)
        # Few groups of items hold one that may matter to a query, so only those are looked at pair by pair.
        groups = -(-n // GROUP_ITEMS)
        product = self._product(piece, rough, groups * GROUP_ITEMS)
        asked = product.shape[1]
        with np.errstate(all="ignore"):
            hit = ~(product.reshape(groups, GROUP_ITEMS, asked).max(axis=1) < bound)
            hit[:, self.is_odd[piece]] = True
            group, owner = np.divmod(np.flatnonzero(hit), asked)
            places = (group * GROUP_ITEMS * asked + owner)[:, None] + np.arange(GROUP_ITEMS) * asked
            reached = product.ravel()[places] >= bound[owner, None]
        reached[self.is_odd[piece][owner]] = True
        places, cols = np.divmod(np.flatnonzero(reached), GROUP_ITEMS)
        cols, rows = cols + group[places] * GROUP_ITEMS, owner[places] + piece.start
        real = cols < n
        return cols[real], rows[real]

    def _tile(self, piece, numbers, v, rough, wide, longest, codes) -> None:
        cols, rows = self._likely(piece, rough, longest)
        if rough.dtype == np.float32 and self.longest_tile >= self.step and len(rows) > len(v) * len(self.lengths[piece]) // 16:
            # Too close for single precision.
            cols, rows = self._likely(piece, wide, longest)
        if len(rows):
            self._propose(rows, cols, numbers, v, codes)

    def _propose(self, rows, cols, numbers, v, codes) -> None:
        """Exact scores of pairs; those that are among the k best so far wait for the next merge."""
        for own, other in zip(self.codes, codes):
            apart = (other[cols] < 0) | (own[rows] != other[cols])
            rows, cols = rows[apart], cols[apart]
        piece = max(1, EXACT_ENTRIES // self.q.shape[1])
        for start in range(0, len(rows), piece):
            r, c = rows[start : start + piece], cols[start : start + piece]
            left, right = self.q[r], v[c]
            with np.errstate(all="ignore"):
                if self.metric == "euclidean":
                    gap = left - right
                    scores = 1.0 / (1.0 + np.sqrt(np.einsum("ij,ij->i", gap, gap)))
                else:
                    scores = np.einsum("ij,ij->i", left, right)
                scores = np.round(scores, TIE_DIGITS)
            items, worst = numbers[c], self.scores[r, -1]
            better = (scores > worst) | ((scores == worst) & (items < self.items[r, -1]))
            if better.any():
                self.waiting.append((r[better], scores[better], items[better]))
                self.n_waiting += int(better.sum())

    def _merge(self) -> None:
        if not self.waiting:
            return
        rows, scores, items = (np.concatenate(parts) for parts in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        counts = np.bincount(rows, minlength=len(self.q))
        # The first sort is cheap for many queries with a few pairs each, the second bounded for queries with many.
        few = counts[rows] <= 2 * self.k
        if few.any():
            self._merge_few(rows[few], scores[few], items[few], counts)
        if not few.all():
            self._merge_many(rows[~few], scores[~few], items[~few])
        touched = np.flatnonzero(counts)
        self.least[touched] = np.maximum(self.least[touched], floor_of(self.metric, self.scores[touched, -1]))

    def _merge_few(self, rows, scores, items, counts) -> None:
        order = np.argsort(rows, kind="stable")
        rows, scores, items = rows[order], scores[order], items[order]
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        touched, row = rows[first], np.cumsum(first) - 1
        place = np.arange(len(rows)) - np.flatnonzero(first)[row]
        width = self.k + int(counts[touched].max())
        wide_scores, wide_items = np.full((len(touched), width), -np.inf), np.full((len(touched), width), NO_ITEM)
        wide_scores[:, : self.k], wide_items[:, : self.k] = self.scores[touched], self.items[touched]
        wide_scores[row, self.k + place], wide_items[row, self.k + place] = scores, items
        order = np.lexsort((wide_items, -wide_scores), axis=-1)[:, : self.k]
        self.scores[touched] = np.take_along_axis(wide_scores, order, axis=1)
        self.items[touched] = np.take_along_axis(wide_items, order, axis=1)

    def _merge_many(self, rows, scores, items) -> None:
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.k), rows])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        items = np.concatenate([self.items[touched].ravel(), items])
        order = np.lexsort((items, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < self.k
        order, rows, place = order[first], rows[first], place[first]
        self.scores[rows, place], self.items[rows, place] = scores[order], items[order]

    def found(self) -> pa.Table:
        self._merge()
        rows, places = np.nonzero(self.items != NO_ITEM)
        columns = [pa.array(self.numbers[rows]), pa.array(self.items[rows, places]), pa.array(self.scores[rows, places])]
        return pa.table(columns, names=FOUND.names)


class NumberedSearch:
    """Of tables with numbers, vectors and labels: ``_asked`` and ``_item`` of the k best pairs, never one with a pair of equal labels."""

    def __init__(self, k: int, metric: str, labels: Sequence[tuple[str, str]]):
        self.k, self.metric, self.labels = k, metric, tuple(labels)

    def start(self, queries: pa.Table) -> RunningBest:
        # A floor known from elsewhere has its slack already.
        floor = queries.column("_floor").to_numpy() if "_floor" in queries.column_names else None
        labels = [queries.column(left).combine_chunks() for left, _ in self.labels]
        return RunningBest(self.k, self.metric, queries.column("_asked").to_numpy(), matrix_of(queries.column("_vector"), self.metric), labels, floor)

    def add(self, best: RunningBest, items: pa.Table | pa.RecordBatch) -> None:
        table = pa.Table.from_batches([items]) if isinstance(items, pa.RecordBatch) else items
        labels = [table.column(right).combine_chunks() for _, right in self.labels]
        best.add(table.column("_item").to_numpy(), matrix_of(table.column("_vector"), self.metric), labels)

    def run(self, queries: pa.Table, chunks: Iterable[pa.Table]) -> pa.Table | None:
        if not queries.num_rows:
            return None
        best = self.start(queries)
        for chunk in chunks:
            if chunk.num_rows:
                self.add(best, chunk)
        return best.found()

    def nothing(self, queries: pa.Table, items: pa.Table) -> pa.Table:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=FOUND.names)


def scanned(shared, items: DataFrame, search: NumberedSearch) -> DataFrame:
    """Few queries, which travel to the items: k rows a query and partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = search.run(shared.value, (pa.Table.from_batches([batch]) for batch in batches))
        if found is not None:
            yield from found.to_batches()

    return items.mapInArrow(scan, FOUND)


def streamed(queries: DataFrame, items: DataFrame, search: NumberedSearch, n_queries: int, n_items: int, query_rows: int) -> DataFrame:
    """Every block of queries meets all items in a stream, in one task or, if blocks are few, in some that share the items."""
    size = queries.agg(F.max(F.size("_vector"))).first()[0] or 1
    rows = max(1, min(query_rows, BLOCK_BYTES // (8 * max(1, size))))
    n_blocks, cells = max(1, -(-n_queries // rows)), 4 * queries.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-cells // n_blocks), n_items // PART_ITEMS))
    n_blocks = max(n_blocks, -(-cells // parts))

    def dealt(number: str, count: int) -> Column:
        return F.pmod(F.xxhash64(number), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    def labels(side: int) -> list[Column]:
        return [F.col(pair[side]).alias(f"_label{i}") for i, pair in enumerate(search.labels)]

    # Odd turns are those of the items, after the queries of their cell.
    left = queries.select("_asked", "_vector", *labels(0), dealt("_asked", n_blocks).alias("_block"))
    left = left.select((F.col("_block") * parts).alias("_first"), "*").select("*", every(parts).alias("_part"))
    left = left.select(((F.col("_first") + F.col("_part")) * 2).alias("_turn"), F.col("_asked").alias("_item"), "_vector", *[f"_label{i}" for i in range(len(search.labels))])
    right = items.select("_item", "_vector", *labels(1), dealt("_item", parts).alias("_part")).select("*", every(n_blocks).alias("_block"))
    right = right.select(((F.col("_block") * parts + F.col("_part")) * 2 + 1).alias("_turn"), "_item", "_vector", *[f"_label{i}" for i in range(len(search.labels))])
    tasks = min(blocks.MAX_TASKS, n_blocks * parts)
    cell = F.pmod(F.shiftright("_turn", 1), F.lit(tasks)).cast("int")
    stream = left.unionByName(right).repartitionById(tasks, cell).sortWithinPartitions("_turn")
    told = NumberedSearch(search.k, search.metric, [(f"_label{i}", f"_label{i}") for i in range(len(search.labels))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked, best = None, [], None
        for batch in batches:
            turns = batch.column("_turn").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                cell, is_item = divmod(int(turns[start]), 2)
                if cell != current:
                    if best is not None:
                        yield from best.found().to_batches()
                    current, asked, best = cell, [], None
                piece = batch.slice(start, stop - start)
                if not is_item:
                    asked.append(piece)
                    continue
                if best is None and asked:
                    table = pa.Table.from_batches(asked)
                    best = told.start(table.rename_columns(["_asked" if name == "_item" else name for name in table.column_names]))
                    asked = []
                if best is not None:
                    told.add(best, piece)
        if best is not None:
            yield from best.found().to_batches()

    return stream.mapInArrow(scan, FOUND)
