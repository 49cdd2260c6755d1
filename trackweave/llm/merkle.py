"""Merkle manifest of a dataset with a proof for every row.

Rows are leaves, sorted into one tree per group; the groups' subroots are the leaves of a last tree. Leaf partitions are
contiguous blocks of bounded size. Each derives what interiors it can from its own leaves and hands up the nodes whose
parents it cannot form; these few are combined level by level. For the proofs each block lists the least union of nodes
that it lacks, fetches them once by a join, derives the interiors its leaves share and expands their proofs locally.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trackweave.llm.common import located, stored
from trackweave.session import ship_package

ARITY = 8
DIGEST = 64  # characters of a digest
# Leaves of one leaf partition: what one Python call holds.
BLOCK = 8_192
# Leaves of one range partition grow beyond a block only where there would be more partitions than this.
MAX_PARTITIONS = 20_000

PROOF = "array<struct<place:int,siblings:string>>"


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def named(column: str) -> Column:
    """A column by its whole name, dots included, of whatever table it is read from."""
    return F.col(f"`{column}`")


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: per value ``-`` if null, else its UTF-8 bytes' number, a colon and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return sha256(F.concat(*[part(value) for value in values]))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to: level by level the node is put into its place among its siblings."""

    def up(node: Column, step: Column) -> Column:
        siblings, before = step["siblings"], step["place"] * DIGEST
        return sha256(F.concat(siblings.substr(F.lit(1), before), node, siblings.substr(before + 1, F.lit(ARITY * DIGEST))))

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, lowest level first, left to right."""
    return sha256(F.array_join(F.transform(proof, lambda step: step["siblings"]), ""))


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    group: str = "lang",
    order: str = "doc_id",
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``order, leaf, subroot, root, proof`` and the columns of ``also``: one row per row of ``docs``.

    A leaf is the digest of ``fields``. Leaves of a group ascend by ``order``; every eight consecutive nodes, the last run
    fewer, become the digest of their digests until one node remains, the group's subroot, which a lone leaf is itself.
    Subroots, ordered by the group's value as UTF-8 bytes, become the root in the same way. ``proof`` has one step a level,
    the siblings of the node and its place among them, from the leaf's level to below the root.

    A null group is a group and comes first; null orders come first. Equal orders ascend by leaf, repeated rows have equal
    leaves and a proof each. Empty texts are values, not nulls. Other columns are not read, whatever their names. An
    empty table gives no rows.
    """
    own = dict(also or {})
    keyed = F.coalesce(F.concat(F.lit("="), named(group).cast("string")), F.lit("-"))
    columns = {"_group": keyed, "_order": named(order), "_leaf": leaf_digest([named(f) for f in fields])}
    leaves = located(docs, columns | {f"_also_{i}": column for i, column in enumerate(own.values())})
    leaves = stored(leaves.drop("_split"), "leaves")
    carried = [f"_also_{i}" for i in range(len(own))]
    lower = _Forest(leaves, ["_order", "_leaf", "_file", "_row"], ["_order", *carried])
    # The subroots are the leaves of one more tree.
    tops = lower.tops().select(F.lit("").alias("_group"), F.col("_group").alias("_order"), F.col("digest").alias("_leaf"))
    upper = _Forest(stored(tops, "subroots"), ["_order"], ["_order"])
    above = stored(upper.proofs().drop("root").withColumnRenamed("top", "root"), "root")
    above = above.select(F.col("_order").alias("_group"), "root", F.col("proof").alias("above"))
    proved = lower.proofs(above)
    return proved.select(
        F.col("_order").alias(order),
        F.col("_leaf").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        "proof",
        *[F.col(name).alias(alias) for name, alias in zip(carried, own, strict=True)],
    )


class _Forest:
    """One tree per ``_group`` over ``leaves`` in the given order."""

    def __init__(self, leaves: DataFrame, order: list[str], carry: list[str]):
        ship_package(leaves.sparkSession)
        self.carry = carry
        total = leaves.count()
        parts = min(MAX_PARTITIONS, max(1, math.ceil(total / BLOCK)))
        by = ["_group", *order]
        placed = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        # The number of the partition above bit 33, the place inside it below.
        placed = placed.select("_group", "_leaf", *carry, F.monotonically_increasing_id().alias("_at"))
        placed = placed.withColumn("_block", F.shiftleft(F.shiftright("_at", 33), 24) + F.floor(F.col("_at") % (1 << 33) / BLOCK))
        self.leaves = stored(placed, "sorted-leaves")
        self.runs = stored(self._runs(), "runs")
        orphans = stored(self._orphans(), "orphans")
        self.nodes = self._combined(orphans)

    def _runs(self) -> DataFrame:
        """Each stretch of a group inside a block: where it starts among the group's leaves, and how many these are."""
        runs = self.leaves.groupBy("_group", "_block").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy("_group")
        before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
        return runs.select("*", start, F.sum("n").over(whole).alias("size"))

    def _orphans(self) -> DataFrame:
        """Nodes that a block derives from its own leaves but whose parent it cannot; tops of whole trees too."""
        schema = T.StructType(
            [T.StructField("_group", T.StringType()), T.StructField("size", T.LongType())]
            + [T.StructField(name, T.LongType()) for name in ("level", "place")]
            + [T.StructField("digest", T.StringType())]
        )

        def derive(leaves: pa.Table, runs: pa.Table) -> pa.Table:
            rows = []
            for run, digests in _slices(leaves, runs):
                rows += [(run["_group"], run["size"], *node) for node in orphans_of(digests, run["start"], run["size"])]
            return _table(rows, schema)

        leaves = self.leaves.select("_block", "_at", "_leaf")
        return leaves.groupBy("_block").cogroup(self.runs.groupBy("_block")).applyInArrow(derive, schema)

    def _combined(self, orphans: DataFrame) -> DataFrame:
        """The orphans and all nodes above them; a round per level, each some eight times smaller."""
        largest = self.runs.agg(F.max("size")).first()[0] or 1
        nodes, produced = orphans, None
        for level in range(height(largest)):
            here = orphans.filter(F.col("level") == level)
            here = here if produced is None else here.unionByName(produced)
            # The top of a tree has no parent.
            wide = F.ceil(F.col("size") / float(ARITY**level)) > 1
            parent = F.floor(F.col("place") / ARITY)
            children = F.array_sort(F.collect_list(F.struct("place", "digest")))
            joined = F.array_join(F.transform(children, lambda c: c["digest"]), "")
            groups = here.filter(wide).groupBy("_group", "size", parent.alias("place")).agg(sha256(joined).alias("digest"))
            produced = stored(groups.withColumn("level", F.lit(level + 1).cast("long")), "nodes")
            nodes = nodes.unionByName(produced)
        return nodes

    def tops(self) -> DataFrame:
        """``_group, digest``: the root of each tree."""
        # The one node of its level.
        return self.nodes.filter(F.col("size") <= F.pow(F.lit(float(ARITY)), "level")).select("_group", "digest")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """``carry..., _leaf, top, proof``, and with ``above`` (``_group, root, above``) the root and the proof up to it."""
        runs = self.runs
        if above is None:
            none = F.lit(None)
            runs = runs.select("*", none.cast("string").alias("root"), none.cast(PROOF).alias("above"))
        else:
            runs = runs.join(above, "_group")
        wanted = T.StructType([*self.runs.select("_group", "_block", "first").schema, *_node_fields()])

        def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for run in batch.to_pylist():
                    nodes = missing_nodes(run["start"], run["n"], run["size"])
                    rows += [(run["_group"], run["_block"], run["first"], *node) for node in nodes]
                yield from _table(rows, wanted).to_batches()

        asked = self.runs.mapInArrow(lacking, wanted)
        fetched = asked.join(self.nodes.drop("size"), ["_group", "level", "place"])
        fetched = fetched.select("_block", "first", "level", "place", "digest")
        beside = runs.drop("_group").unionByName(fetched, allowMissingColumns=True)
        leaves = self.leaves.drop("_group")
        out = leaves.select(*self.carry, "_leaf").schema
        schema = T.StructType(
            [*out, T.StructField("top", T.StringType()), T.StructField("root", T.StringType())]
            + [T.StructField("proof", T.ArrayType(_STEP))]
        )
        arrow = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))
        names = [f.name for f in out]

        def expand(leaves: pa.Table, beside: pa.Table) -> pa.Table:
            rows = beside.to_pylist()
            nodes: dict[int, dict] = {}
            for row in rows:
                if row["level"] is not None:
                    nodes.setdefault(row["first"], {})[row["level"], row["place"]] = row["digest"]
            leaves = leaves.sort_by("_at")
            at = leaves.column("_at").to_pylist()
            place = {first: i for i, first in enumerate(at)}
            tables = []
            for run in (row for row in rows if row["level"] is None):
                own = leaves.slice(place[run["first"]], run["n"])
                proofs, top = proofs_of(own.column("_leaf").to_pylist(), run["start"], run["size"], nodes.get(run["first"], {}))
                tail = [(step["place"], step["siblings"]) for step in run["above"] or []]
                steps = [step for proof in proofs for step in (*proof, *tail)]
                length = len(proofs[0]) + len(tail)
                column = pa.ListArray.from_arrays(
                    pa.array(range(0, length * len(proofs) + 1, length) if length else [0] * (len(proofs) + 1), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.string())],
                        fields=list(arrow.value_type),
                    ),
                )
                columns = [own.column(name) for name in names]
                ends = [pa.array([value] * own.num_rows, pa.string()) for value in (top, run["root"])]
                tables.append(pa.table([*columns, *ends, column], names=[*names, "top", "root", "proof"]))
            return pa.concat_tables(tables)

        return leaves.groupBy("_block").cogroup(beside.groupBy("_block")).applyInArrow(expand, schema)


_STEP = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.StringType())])


def _node_fields() -> list[T.StructField]:
    return [T.StructField(name, T.LongType()) for name in ("level", "place")]


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=schema.names)


def _slices(leaves: pa.Table, runs: pa.Table) -> Iterator[tuple[dict, list[str]]]:
    """The runs of a block, each with its leaves in order."""
    leaves = leaves.sort_by("_at")
    digests = leaves.column("_leaf").to_pylist()
    place = {at: i for i, at in enumerate(leaves.column("_at").to_pylist())}
    for run in runs.to_pylist():
        first = place[run["first"]]
        yield run, digests[first : first + run["n"]]


# --- one run of consecutive leaves ----------------------------------------------------------------


def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def orphans_of(digests: list[str], start: int, size: int) -> list[tuple[int, int, str]]:
    """(level, place, digest) of the nodes that these leaves give but whose parents need others; the top if they give it."""
    found, level, known = [], 0, digests
    while known and size > 1:
        end = start + len(known)
        first = -(-start // ARITY)  # parents below `last` from `first` on have all their children here
        last = -(-end // ARITY) if end == size else end // ARITY
        if last <= first:
            return found + [(level, start + i, d) for i, d in enumerate(known)]
        low, high = first * ARITY - start, min(last * ARITY, size) - start
        found += [(level, start + i, d) for i, d in enumerate(known) if not low <= i < high]
        known = [_digest("".join(known[i : min(i + ARITY, high)])) for i in range(low, high, ARITY)]
        start, size, level = first, -(-size // ARITY), level + 1
    return found + [(level, start + i, d) for i, d in enumerate(known)]


def missing_nodes(start: int, n: int, size: int) -> list[tuple[int, int]]:
    """(level, place) of the least set of nodes that leaves ``start`` to ``start + n`` need for all their proofs.

    On every level these are the siblings of known nodes that are not known themselves; all parents of known nodes
    are known on the next.
    """
    found, level, end = [], 0, start + n
    while size > 1:
        first, last = start - start % ARITY, min(size, -(-end // ARITY) * ARITY)
        found += [(level, place) for place in (*range(first, start), *range(end, last))]
        start, end, size, level = start // ARITY, -(-end // ARITY), -(-size // ARITY), level + 1
    return found


def proofs_of(
    digests: list[str], start: int, size: int, fetched: Mapping[tuple[int, int], str]
) -> tuple[list[list[tuple[int, str]]], str]:
    """For every leaf its steps (place, siblings) upwards, and the top. Interiors and siblings are formed once per node."""
    levels, known, first_leaf, level = [], digests, start, 0
    while size > 1:
        end = start + len(known)
        first, last = start - start % ARITY, min(size, -(-end // ARITY) * ARITY)
        row = [fetched[level, i] for i in range(first, start)] + known + [fetched[level, i] for i in range(end, last)]
        steps, parents = [], []
        for at in range(0, len(row), ARITY):
            joined = "".join(row[at : at + ARITY])
            parents.append(_digest(joined))
            own = range(max(first + at, start), min(first + at + ARITY, end))
            for place in (i % ARITY for i in own):
                steps.append((place, joined[: DIGEST * place] + joined[DIGEST * (place + 1) :]))
        levels.append((start, ARITY**level, steps))
        known, start, size, level = parents, first // ARITY, -(-size // ARITY), level + 1
    proofs = [
        [steps[leaf // width - low] for low, width, steps in levels] for leaf in range(first_leaf, first_leaf + len(digests))
    ]
    return proofs, known[0]
