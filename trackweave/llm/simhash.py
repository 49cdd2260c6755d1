"""Near-duplicates by SimHash fingerprints, found through vantage-point trees.

Two fingerprints within ``distance`` bits differ by at most ``radius`` bits in one of ``distance // (radius + 1) + 1``
parts of their bits. Each part has a vantage-point tree: a node sends fingerprints nearer to its vantage than the
median to the left, the others to the right. The distance on a part of the bits obeys the triangle inequality, so a
neighbour within ``radius`` can lie on the other side only if the fingerprint is within ``radius`` of the border;
only then it is also sent there as a visitor. A leaf is a shard: its own fingerprints are compared
with each other and with its visitors on all 64 bits. Trees are fitted on a bounded sample; all fingerprints are
dealt to them, and the search is exact whatever the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import join_hot, located, scanned, stored
from trackweave.llm.components import components
from trackweave.session import ship_package

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
RADIUS = 1
# Fingerprints of a shard, about; rows that one comparison holds; fingerprints that the trees are fitted on.
LEAF_ROWS = 2048
CELL_ROWS = 16_384
SAMPLE_ROWS = 65_536
MAX_DEPTH = 14
MATRIX = 1 << 21
HALF = np.uint64(1 << 63)


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if it is set in more than half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends[: -SHINGLE_WORDS].tolist()]
    stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    total = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    for start in range(0, len(rows), 65_536):
        total += np.unpackbits(rows[start : start + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, the columns ``carry``, ``_print`` (the 64 bits as a signed number) per row of ``docs``."""
    carried = [docs.schema[name] for name in carry]
    schema = T.StructType([T.StructField("_id", docs.schema[id_column].dataType), *carried, T.StructField("_print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), dtype=np.uint64, count=batch.num_rows)
            columns = [batch.column(name) for name in ("_id", *carry)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], schema.names)

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *carry).mapInArrow(run, schema)


@dataclass(frozen=True)
class VantageTree:
    """A complete tree in level order over the bits of ``mask``."""

    mask: np.uint64
    depth: int
    vantage: np.ndarray
    border: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, mask: np.uint64, depth: int, seed: int) -> VantageTree:
        rng = np.random.default_rng(seed)
        vantage, border = np.zeros((1 << depth) - 1, dtype=np.uint64), np.zeros((1 << depth) - 1, dtype=np.int64)
        parts = [sample]
        for node in range((1 << depth) - 1):
            part = parts[node]
            if len(part):
                vantage[node] = part[rng.integers(len(part))]
                away = np.bitwise_count((part ^ vantage[node]) & mask).astype(np.int64)
                # The border that divides the sample most evenly.
                below = np.cumsum(np.bincount(away, minlength=65)) / len(part)
                border[node] = int(np.abs(below - 0.5).argmin())
                parts += [part[away <= border[node]], part[away > border[node]]]
            else:
                parts += [part, part]
        return VantageTree(mask, depth, vantage, border)

    def deal(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, own): every row in its own leaf, and in those of larger number that a neighbour may be in."""
        row = np.arange(len(prints))
        node, own = np.zeros(len(prints), dtype=np.int64), np.ones(len(prints), dtype=bool)
        for _ in range(self.depth):
            away = np.bitwise_count((prints[row] ^ self.vantage[node]) & self.mask).astype(np.int64)
            border = self.border[node]
            home_right = away > border
            left = (own & ~home_right) | (~own & (away - radius <= border))
            # A pair is found in the larger of its two leaves, so own rows visit to the right only.
            right = (own & home_right) | (away + radius > border)
            row = np.concatenate([row[left], row[right]])
            node, own = (
                np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]),
                np.concatenate([own[left], (own & home_right)[right]]),
            )
        return row, node - (1 << self.depth) + 1, own


def bit_parts(distance: int, radius: int) -> list[np.uint64]:
    """Masks of contiguous parts of near equal size, of which one holds at most ``radius`` differences."""
    parts = distance // (radius + 1) + 1
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fit_forest(prints: DataFrame, count: int, distance: int, radius: int, leaf_rows: int = LEAF_ROWS) -> list[VantageTree]:
    """A tree for each part of the bits, fitted on at most ``SAMPLE_ROWS`` distinct fingerprints taken by their hash."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, count) / leaf_rows))))
    share = min(1.0, SAMPLE_ROWS / max(1, count))
    taken = F.pmod(F.xxhash64("_print"), F.lit(1_000_000)) < int(1_000_000 * share) + 1
    sample = prints.filter(taken).select("_print").limit(2 * SAMPLE_ROWS).toArrow()
    values = np.sort(sample.column("_print").to_numpy()).view(np.uint64)
    return [VantageTree.fit(values, mask, depth, seed) for seed, mask in enumerate(bit_parts(distance, radius))]


def _near(left: np.ndarray, right: np.ndarray, distance: int, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``distance``, a block of a bounded matrix at a time."""
    step = max(1, MATRIX // max(1, len(right)))
    for start in range(0, len(left), step):
        block = left[start : start + step]
        first = start + 1 if triangle else 0
        r, c = np.nonzero(np.bitwise_count(block[:, None] ^ right[None, first:]) <= distance)
        r, c = r + start, c + first
        keep = c > r if triangle else slice(None)
        yield r[keep], c[keep]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least index that each point reaches, with the pairs added to what joins points."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def links(prints: DataFrame, count: int, distance: int = DISTANCE, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a, b``: links that join the same components as all pairs of distinct ``_print`` within ``distance``.

    A shard gives at most a link for each of its rows, not its pairs. A shard of more than ``cell_rows`` rows is cut
    into cells, each of which compares two of its blocks, so no task holds more and no pair is left out.
    """
    spark = prints.sparkSession
    ship_package(spark)
    forest = spark.sparkContext.broadcast(fit_forest(prints, count, distance, radius, leaf_rows))
    dealt_schema = "tree int, leaf int, own boolean, _print long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("_print").to_numpy().view(np.uint64)
            for start in range(0, len(values), 2048):
                some = values[start : start + 2048]
                for number, tree in enumerate(forest.value):
                    row, leaf, own = tree.deal(some, radius)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), number, dtype=np.int32)),
                            pa.array(leaf.astype(np.int32)),
                            pa.array(own),
                            pa.array(some[row].view(np.int64)),
                        ],
                        ["tree", "leaf", "own", "_print"],
                    )

    def compare(key, table):
        values = table.column("_print").to_numpy().view(np.uint64)
        own, block = table.column("own").to_numpy(), table.column("block").to_numpy()
        low, high = key[2].as_py(), key[3].as_py()
        index = np.arange(len(values))
        if low == high:
            mine, visiting = index[own], index[~own]
            meetings = [(mine, mine, True), (mine, visiting, False)]
        else:
            # Own rows meet everything of the other block once, and its visitors from either side.
            meetings = [(index[own & (block == side)], index[(block != side) & (~own | (side == low))], False) for side in (low, high)]
        root = index.copy()
        for left, right, triangle in meetings:
            for r, c in _near(values[left], values[right], distance, triangle):
                root = _join(root, left[r], right[c])
        moved = np.flatnonzero(root != index)
        ends = values[moved].view(np.int64), values[root[moved]].view(np.int64)
        return pa.table([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    dealt = prints.select("_print").mapInArrow(deal, dealt_schema)
    # What a shard holds is counted by dealing once more, which is cheaper than keeping the copies.
    large = dealt.groupBy("tree", "leaf").count().filter(F.col("count") > cell_rows)
    cuts = stored(large.select("tree", "leaf", F.ceil(2 * F.col("count") / cell_rows).cast("int").alias("_of_leaf")), "cuts")
    # A row for a leaf at most, of which there are ``2 ** MAX_DEPTH`` a tree.
    known = dealt.join(F.broadcast(cuts), ["tree", "leaf"], "left").withColumn("_cuts", F.coalesce("_of_leaf", F.lit(1)))
    blocks = known.withColumn("block", F.pmod(F.xxhash64("_print"), F.col("_cuts")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("_other")
    cells = blocks.select("tree", "leaf", "own", "_print", "block", partner)
    cells = cells.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_other")
    return cells.groupBy("tree", "leaf", "low", "high").applyInArrow(compare, LINK)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; shingles are of four words, repeats counted, a
    shorter text is one shingle. Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the
    smallest id reachable over links, itself included. Null and empty texts have fingerprint zero, linked like any
    other. A null id gets its component's smallest id, null if all are. Equal fingerprints are one node, so copies cost
    a row; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    joined = _grouped(rows, F.col("_id"), distance)
    return joined.select(
        F.col("_id").alias(id_column),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The first row of each component, all columns as they were.

    Rows are told apart by where they lie, not by their ids: first is the smallest id, a null id being larger than all
    others, and of rows that repeat it the one lying first in the table. So one row of every component stays,
    whatever ids its rows have and wherever else these ids occur.
    """
    docs = scanned(docs)
    lying = located(docs, {"_id": F.col(id_column), "_text": F.col(text_column)})
    rows = stored(fingerprints(lying, "_id", "_text", ("_file", "_row")), "fingerprints")
    grouped = _grouped(rows, F.struct(F.col("_id").isNull().alias("none"), "_id", "_file", "_row"), distance)
    stays = (F.col("_file") == F.col("_least._file")) & (F.col("_row") == F.col("_least._row"))
    marked = located(docs, {"_doc": F.struct(*docs.columns)})
    return marked.join(grouped.filter(~stays).select("_file", "_row"), ["_file", "_row"], "left_anti").select("_doc.*")


def _grouped(rows: DataFrame, order: Column, distance: int) -> DataFrame:
    """``rows`` (with ``_print``) and ``_least``: the least ``order`` of each one's component."""
    nodes = rows.groupBy("_print").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "distinct-fingerprints")
    roots = components(links(nodes, nodes.count(), distance))
    labelled = nodes.join(roots, nodes["_print"] == roots["a"], "left")
    labelled = stored(labelled.select("_print", "_least", "copies", F.coalesce("root", "_print").alias("root")), "labels")
    named = labelled.groupBy("root").agg(F.min("_least").alias("_of_root"), F.count(F.lit(1)).alias("members"))
    members = join_hot(labelled, named, ["root"], "members", labelled.count(), "inner")
    members = members.select("_print", F.col("_of_root").alias("_least"), "copies")
    return join_hot(rows, members, ["_print"], "copies", rows.count(), "inner")
