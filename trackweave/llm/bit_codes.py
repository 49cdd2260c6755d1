"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector less the mean is turned by a random rotation and kept as the signs of its coordinates, packed into words, with a
few correction scalars. Inner products are estimated from the packed bits with an error bound; only vectors whose bound reaches
the best exact scores so far are scored exactly.

With r = |x - c|, o = (x - c) / r, s the sign vector of the turned o over the root of its dimension and f = <s, o>,
<q, o> is near <q, s> / f, and their difference is below |q| sqrt((1 - f^2) / f^2) epsilon / sqrt(D - 1) but for a share
of pairs that falls with epsilon like a normal tail.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import join_hot, stored
from trackweave.llm.whitening import finite, matrix
from trackweave.operators import blocks
from trackweave.operators.ranking import top_n_per_group
from trackweave.session import ship_package

NEAREST = 20
# Width of the error bound in standard deviations.
EPSILON = 3.0
# Bits of a query's coordinates; what they leave out is added to the bound.
QUERY_BITS = 6
SEED = 20
# Distinct query vectors that travel to the tasks; more meet the codes block by block.
QUERY_ROWS = 4096
BLOCK_ROWS = 20_000
# Estimates held at once in a task.
ESTIMATES = 2_000_000


def nearest_by_codes(
    embeddings: DataFrame,
    k: int = NEAREST,
    every: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    epsilon: float = EPSILON,
    query_rows: int = QUERY_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for ids that ``every`` divides the k rows of largest inner product found.

    All rows are coded and all take part but the query's own. Scores are exact, in double precision; ties go to the
    smaller id. Fewer candidates than k are all returned. Left out are null ids and vectors that are null, empty, zero or
    hold null or non-finite entries, as well as those of another length than the most frequent one (of equally frequent
    ones the longest). Repeated rows count once; of an id with several vectors the one that sorts first counts. Other
    columns are not read. An empty table gives no rows.

    Equal vectors are one class with the k + 1 smallest of their ids, so a vector that fills a third of the table is scored
    once. Tasks keep k + 1 rows per distinct query. Work is a few operations on words per query and class.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows, dim = _usable(embeddings, id_column, vector_column)
    classes = top_n_per_group(rows, ["_hash", "_vector"], [F.col("_id")], k + 1).drop("rank")
    classes = classes.groupBy("_hash", "_vector").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    classes = stored(classes, "classes")
    coder = Coder(dim, _mean(classes, dim))
    codes = stored(classes.drop("_hash").mapInArrow(coder.encode, _coded_schema(classes)), "codes")

    asked = stored(rows.filter(F.col("_id") % every == 0), "queries")
    distinct = asked.groupBy("_hash", "_vector").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct, "distinct-queries")
    partial = _searched(distinct.select("first", "_vector"), codes, coder, k + 1, epsilon, query_rows, block_rows)
    best = top_n_per_group(partial, ["first"], [F.col("score").desc(), F.col("vec_id")], k + 1, "_rank")
    hits = F.sort_array(F.collect_list(F.struct("_rank", "vec_id", "score")))
    best = best.groupBy("first").agg(hits.alias("_hits"))
    known = stored(distinct.join(best, "first").select("_hash", "_vector", "n", "_hits"), "answers")
    answered = join_hot(asked, known, ["_hash", "_vector"], "n", asked.count(), "inner")
    own = F.slice(F.filter("_hits", lambda hit: hit["vec_id"] != F.col("_id")), 1, k)
    listed = answered.select(F.col("_id").alias("query_id"), F.posexplode(own).alias("_place", "_hit"))
    return listed.select("query_id", (F.col("_place") + 1).alias("rank"), F.col("_hit.vec_id").alias("vec_id"), "_hit.score")


def _usable(embeddings: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """``_id, _hash, _vector`` with one row per id, and the vectors' length."""
    vector = embeddings[vector_column]
    good = finite(vector) & embeddings[id_column].isNotNull() & F.exists(vector, lambda c: c != 0)
    rows = embeddings.filter(good).select(embeddings[id_column].cast("long").alias("_id"), vector.alias("_vector"))
    sizes = rows.groupBy(F.size("_vector").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 1
    rows = rows.filter(F.size("_vector") == dim)
    if rows.groupBy("_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("_id").agg(F.min("_vector").alias("_vector"))
    return rows.select("_id", F.xxhash64("_vector").alias("_hash"), "_vector"), dim


def _mean(classes: DataFrame, dim: int) -> np.ndarray:
    """Mean of the distinct vectors: a row per task and dimension, added up in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            if batch.num_rows:
                total += matrix(batch.column(0)).astype(np.float64).sum(axis=0)
                n += batch.num_rows
        columns = [pa.array(range(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "s", "n"])

    sums = classes.select("_vector").mapInArrow(partial, "i int, s double, n long").groupBy("i").agg(F.sum("s"), F.sum("n"))
    mean = np.zeros(dim)
    for i, s, n in sums.collect():
        mean[i] = s / max(1, n)
    return np.nan_to_num(mean, posinf=0.0, neginf=0.0)


def _coded_schema(classes: DataFrame) -> T.StructType:
    schema = T.StructType([classes.schema["_vector"], classes.schema["ids"], T.StructField("code", T.BinaryType())])
    for name in ("length", "factor", "centre_product"):
        schema = schema.add(name, T.DoubleType())
    return schema


class Coder:
    """A random rotation, the same wherever it is built, and the centre."""

    def __init__(self, dim: int, centre: np.ndarray):
        self.dim, self.centre = dim, centre
        self.words = math.ceil(dim / 64)
        self.bits = 64 * self.words

    def rotation(self) -> np.ndarray:
        """The first ``dim`` rows of an orthogonal matrix, so that a vector is padded to whole words."""
        square = np.random.default_rng(SEED).standard_normal((self.bits, self.bits))
        turned, upper = np.linalg.qr(square)
        return (turned * np.sign(upper.diagonal()))[: self.dim]

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Code and scalars: |x - c|, <s, o> and <x, c>."""
        rotation = self.rotation()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("_vector")).astype(np.float64)
            y = (x - self.centre) @ rotation
            length = np.sqrt(np.einsum("ij,ij->i", y, y))
            factor = np.abs(y).sum(axis=1) / np.where(length > 0, length, 1) / math.sqrt(self.bits)
            packed = np.packbits(y > 0, axis=1, bitorder="little")
            columns = [
                batch.column("_vector"),
                batch.column("ids"),
                pa.array([row.tobytes() for row in packed], pa.binary()),
                pa.array(length),
                pa.array(np.where(length > 0, factor, 1.0)),
                pa.array(x @ self.centre),
            ]
            names = ["_vector", "ids", "code", "length", "factor", "centre_product"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _searched(
    queries: DataFrame, codes: DataFrame, coder: Coder, keep: int, epsilon: float, query_rows: int, block_rows: int
) -> DataFrame:
    """``first, vec_id, score``: the ``keep`` best of every task, per query."""
    schema = "first long, vec_id long, score double"
    small = blocks.small_table(queries, query_rows)
    if small is not None:
        shared = queries.sparkSession.sparkContext.broadcast(small)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks = (pa.Table.from_batches([batch]) for batch in batches)
            yield from search(shared.value, chunks, coder, keep, epsilon).to_batches()

        # Long work on few bytes: the number of tasks is stated, and grows with the rows.
        cores = queries.sparkSession.sparkContext.defaultParallelism
        tasks = max(2 * cores, math.ceil(codes.count() / block_rows))
        return codes.repartition(tasks).mapInArrow(scan, schema)
    keyed = codes.withColumn("_key", F.col("ids")[0])
    cells = blocks.fragment_replicate(queries, keyed, "first", "_key", keyed.count(), query_rows, block_rows)
    return cells.applyInArrow(lambda left, right: search(left, [right], coder, keep, epsilon), schema)


def search(queries: pa.Table, chunks: Iterable[pa.Table], coder: Coder, keep: int, epsilon: float) -> pa.Table:
    """The ``keep`` best (score falling, id rising) of each query among the coded rows of ``chunks``."""
    found = _Found(queries, coder, keep, epsilon)
    # Few columns at a time, so that scores found early spare the later ones.
    step = max(64, min(4096, ESTIMATES // max(1, queries.num_rows)))
    if queries.num_rows:
        for chunk in chunks:
            for start in range(0, chunk.num_rows, step):
                found.add(chunk.slice(start, step))
    return found.table()


class _Found:
    def __init__(self, queries: pa.Table, coder: Coder, keep: int, epsilon: float):
        self.first = queries.column("first").to_numpy()
        self.coder, self.keep, self.epsilon = coder, keep, epsilon
        # Exact k-th best scores so far, and the classes that hold them: query, score, smallest id, all ids.
        self.floor = np.full(len(self.first), -np.inf)
        self.pool = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, object)]
        if not len(self.first):
            return
        self.q = matrix(queries.column("_vector").combine_chunks()).astype(np.float64)
        turned = (self.q - coder.centre) @ coder.rotation()
        self.length = np.sqrt(np.einsum("ij,ij->i", turned, turned))
        unit = turned / np.where(self.length > 0, self.length, 1.0)[:, None]
        # Coordinates as small integers, kept as bit planes.
        low = unit.min(axis=1)
        width = np.maximum((unit.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
        steps = np.rint((unit - low[:, None]) / width[:, None]).astype(np.uint8)
        rest = unit - (low[:, None] + width[:, None] * steps)
        self.rest = np.sqrt(np.einsum("ij,ij->i", rest, rest))
        planes = [np.packbits(steps >> b & 1, axis=1, bitorder="little").view(np.uint64) for b in range(QUERY_BITS)]
        self.planes = np.stack(planes)
        root = math.sqrt(coder.bits)
        # <s, q> is a sum over the bits set, of the steps and of ones, less a constant.
        self.per_step, self.per_bit = 2 * width / root, 2 * low / root
        self.constant = (coder.bits * low + width * steps.sum(axis=1)) / root
        self.centre_product = self.q @ coder.centre - coder.centre @ coder.centre

    def estimates(self, chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products and how far off they may be, query by row."""
        code = np.frombuffer(b"".join(chunk.column("code").to_pylist()), np.uint64).reshape(chunk.num_rows, -1)
        length, factor, product = (chunk.column(c).to_numpy() for c in ("length", "factor", "centre_product"))
        steps = np.zeros((len(self.q), len(code)), np.float32)
        for b, plane in enumerate(self.planes):
            common = np.zeros(steps.shape, np.uint16)
            for word in range(code.shape[1]):
                common += np.bitwise_count(plane[:, None, word] & code[None, :, word])
            steps += common * np.float32(1 << b)
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        with_sign = steps * self.per_step[:, None] + np.outer(self.per_bit, ones) - self.constant[:, None]
        scale = self.length[:, None] * (length / factor)[None, :]
        estimate = with_sign * scale + self.centre_product[:, None] + product[None, :]
        spread = self.epsilon * np.sqrt(np.maximum(0.0, 1 - factor * factor)) / math.sqrt(max(1, self.coder.bits - 1))
        # A hair more than the bound, for rounding.
        return estimate, scale * (spread[None, :] + self.rest[:, None]) + 1e-9 * (1 + np.abs(estimate))

    def add(self, chunk: pa.Table) -> None:
        estimate, error = self.estimates(chunk)
        floor = self.floor
        if chunk.num_rows >= self.keep:
            # At least `keep` rows score as much as this, whatever the error.
            cut = chunk.num_rows - self.keep
            floor = np.maximum(floor, np.partition(estimate - error, cut, axis=1)[:, cut])
        # Bounds that are no numbers rule nothing out.
        rows, columns = np.nonzero(~(estimate + error < floor[:, None]))
        if not len(rows):
            return
        x = matrix(chunk.column("_vector").combine_chunks()).astype(np.float64)
        scores = exact_products(self.q, x, rows, columns)
        likely = scores >= self.floor[rows]
        rows, columns, scores = rows[likely], columns[likely], scores[likely]
        ids = np.empty(chunk.num_rows, object)
        ids[:] = chunk.column("ids").to_pylist()
        first = np.array([own[0] for own in ids], np.int64)
        new = [rows, scores, first[columns], ids[columns]]
        pool = [np.concatenate(pair) for pair in zip(self.pool, new, strict=True)]
        order = np.lexsort((pool[2], -pool[1], pool[0]))
        group = pool[0][order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        self.pool = [part[order][place < self.keep] for part in pool]
        full = np.flatnonzero(place == self.keep - 1)
        self.floor[group[full]] = pool[1][order][full]

    def table(self) -> pa.Table:
        """Classes written out as ids, cut again to ``keep`` per query."""
        query, score, _, ids = self.pool
        sizes = np.array([len(own) for own in ids], np.int64)
        query, score = np.repeat(query, sizes), np.repeat(score, sizes)
        ids = np.array([i for own in ids for i in own], np.int64)
        order = np.lexsort((ids, -score, query))
        group = query[order]
        order = order[np.arange(len(group)) - np.searchsorted(group, group) < self.keep]
        columns = [pa.array(self.first[query[order]], pa.int64()), pa.array(ids[order]), pa.array(score[order])]
        return pa.table(columns, names=["first", "vec_id", "score"])


def exact_products(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in an order that does not depend on the block."""
    result = np.empty(len(rows))
    step = max(1, ESTIMATES // max(1, q.shape[1]))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        result[part] = np.einsum("ij,ij->i", q[rows[part]], x[columns[part]])
    return result
