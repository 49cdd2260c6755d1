"""Sharding by a k-d tree over metadata: every node is cut at the weighted median of its widest dimension.

The tree is grown level by level and stays in Spark. Rows carry the number of their node; all nodes of a level are
measured by one aggregation, and their medians are found together by narrowing: histograms between the bounds of the
nodes say which bin holds each median, and the next histograms look into these bins. What a pass knows is a
table of a row per node, which meets the rows by broadcast up to a stated number of nodes and by a shuffle beyond. The
driver sees how many nodes are open, whatever the size of table and tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import gapless, join_hot, stored, utf8_bytes

# Bins of a node, and of a pass over all nodes.
LEAST_BINS, MOST_BINS, PASS_BINS = 256, 8192, 1 << 20
# A cut may miss its share of the node's bytes by this part of them.
TOLERANCE = 1 / 5_000
TIE_RANGE = float((1 << 53) - 1)
MAX_PASSES = 40
# Rows of a hundred bytes or so that may travel to every task.
TRAVELLING_NODES = 1 << 18
TRAVELLING_BYTES = 8 << 20
# Numbers beyond it count as this far out, so that widths are finite.
FAR = 1e300

STATE = ("_node", "_leaves", "dim", "total", "wanted", "before", "phase", "at", "low", "high", "inside", "open")


def ranked(rows: DataFrame, text: str, output: str, total: int) -> DataFrame:
    """``rows`` with ``output``: the rank of the string in ``text`` among the distinct ones by their bytes, null lowest."""
    values = rows.groupBy(F.col(text).alias("_value")).agg(F.count(F.lit(1)).alias("_met"))
    # Files follow one another in the order of the values, and so do the rows in each.
    ordered = stored(values.orderBy(F.col("_value").asc_nulls_first()), "shard-values")
    lies = ordered.metadataColumn("_metadata")
    ordered = ordered.select("_value", "_met", lies["file_name"].alias("_file"), lies["row_index"].alias("_row"))
    # A file per partition of the sort.
    files = ordered.groupBy("_file").count()
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    numbered = ordered.join(F.broadcast(starts), "_file")
    ranks = numbered.select(F.col("_value").alias(text), "_met", (F.col("_start") + F.col("_row")).cast("double").alias(output))
    size, count = ordered.agg(F.sum(F.coalesce(F.octet_length("_value"), F.lit(0)) + 32), F.count(F.lit(1))).first()
    if (size or 0) <= TRAVELLING_BYTES:
        found = F.broadcast(ranks.select(F.col(text).alias("_value"), output))
        return rows.join(found, rows[text].eqNullSafe(found["_value"]), "left").drop("_value")
    return join_hot(rows, ranks, [text], "_met", total).drop("_met")


def _met(rows: DataFrame, nodes: DataFrame, count: int, how: str) -> DataFrame:
    return rows.join(F.broadcast(nodes) if count <= TRAVELLING_NODES else nodes, ["_node", "_leaves"], how)


def _value(dimensions: list[str]) -> Column:
    """The number of a row in the dimension ``dim``."""
    value = F.col(dimensions[0])
    for i, name in enumerate(dimensions[1:], 1):
        value = F.when(F.col("dim") == i, F.col(name)).otherwise(value)
    return value


def _settled(state: DataFrame) -> DataFrame:
    """``open`` nodes are looked at again. A median inside one value that weighs too much is sought among its ties."""
    rough = F.col("inside") > F.greatest(F.lit(1.0), TOLERANCE * F.col("total"))
    one = F.col("low") == F.col("high")
    tied = (F.col("phase") == 0) & one & rough
    changes = {
        "at": F.when(tied, F.col("low")).otherwise(F.col("at")),
        "open": rough & (~one | tied),
        "phase": F.when(tied, 1).otherwise(F.col("phase")),
        "low": F.when(tied, 0.0).otherwise(F.col("low")),
        "high": F.when(tied, TIE_RANGE).otherwise(F.col("high")),
    }
    return state.withColumns(changes).select(*STATE)


def _measured(rows: DataFrame, dimensions: list[str], spans: list[float]) -> DataFrame:
    """A row per node of more than one leaf: its widest dimension and what the search for its median starts from."""
    least = [F.min(name).alias(f"lo{i}") for i, name in enumerate(dimensions)]
    most = [F.max(name).alias(f"hi{i}") for i, name in enumerate(dimensions)]
    sizes = rows.filter("_leaves > 1").groupBy("_node", "_leaves").agg(F.sum("_weight").cast("double").alias("total"), *least, *most)
    widths = F.array(*[(F.col(f"hi{i}") - F.col(f"lo{i}")) / span if span else F.lit(0.0) for i, span in enumerate(spans)])

    def of_widest(bound: str) -> Column:
        return F.element_at(F.array(*[F.col(f"{bound}{i}") for i in range(len(dimensions))]), F.col("dim") + 1)

    # The first of equally wide ones.
    sizes = sizes.withColumn("dim", (F.array_position(widths, F.array_max(widths)) - 1).cast("int"))
    return sizes.select(
        "_node",
        "_leaves",
        "dim",
        "total",
        (F.col("total") * F.floor(F.col("_leaves") / 2) / F.col("_leaves")).alias("wanted"),
        F.lit(0.0).alias("before"),
        F.lit(0).alias("phase"),
        F.lit(0.0).alias("at"),
        of_widest("lo").alias("low"),
        of_widest("hi").alias("high"),
        F.col("total").alias("inside"),
    )


def _narrowed(rows: DataFrame, state: DataFrame, open_nodes: int, dimensions: list[str]) -> DataFrame:
    """``state`` after one more look into the bin that holds the median of each open node."""
    bins = max(LEAST_BINS, min(MOST_BINS, PASS_BINS // open_nodes))
    here = _met(rows, state.filter("open"), open_nodes, "inner").withColumn("_v", _value(dimensions))
    here = here.filter((F.col("phase") == 0) | (F.col("_v") == F.col("at")))
    here = here.withColumn("_x", F.when(F.col("phase") == 0, F.col("_v")).otherwise(F.col("_tie")))
    here = here.filter(F.col("_x").between(F.col("low"), F.col("high")))
    at = F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)).cast("int"))
    found = here.groupBy("_node", "_leaves", at.alias("_bin")).agg(
        F.sum("_weight").cast("double").alias("_inside"), F.min("_x").alias("_low"), F.max("_x").alias("_high")
    )
    up_to = F.sum("_inside").over(Window.partitionBy("_node").orderBy("_bin"))  # at most ``bins`` rows
    found = found.withColumn("_up_to", up_to).join(state.filter("open"), ["_node", "_leaves"])
    below = F.col("before") + F.col("_up_to") - F.col("_inside")
    found = found.filter((below < F.col("wanted")) & (below + F.col("_inside") >= F.col("wanted")))
    found = found.withColumns({"before": below, "inside": F.col("_inside"), "low": F.col("_low"), "high": F.col("_high")})
    return state.filter("not open").unionByName(_settled(found.select(*STATE)))


def grow(rows: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """``rows`` with ``_node``, the number of their shard from 0.

    ``rows`` have ``_weight``, ``_tie`` in [0, 2**53) and the numeric dimensions, none of them null.
    """
    rows = rows.withColumns({"_node": F.lit(0), "_leaves": F.lit(shards)})
    ends = rows.agg(*[F.max(name) - F.min(name) for name in dimensions]).first()
    spans = [end or 0.0 for end in ends]
    for _ in range(math.ceil(math.log2(shards))):
        state = stored(_settled(_measured(rows, dimensions, spans)), "shard-nodes")
        nodes = state.count()
        for _ in range(MAX_PASSES):
            open_nodes = state.filter("open").count()
            if not open_nodes:
                break
            state = stored(_narrowed(rows, state, open_nodes, dimensions), "shard-nodes")
        # The edge of the last bin that is nearer to the wanted weight.
        with_bin = 2 * (F.col("wanted") - F.col("before")) > F.col("inside")

        def below(x: Column, with_bin: Column = with_bin) -> Column:
            return F.when(with_bin, x <= F.col("high")).otherwise(x < F.col("low"))

        value, half = _value(dimensions), F.floor(F.col("_leaves") / 2).cast("int")
        tied = (value < F.col("at")) | ((value == F.col("at")) & below(F.col("_tie")))
        left = F.when(F.col("phase") == 0, below(value)).otherwise(tied)
        kept = [c for c in rows.columns if c not in ("_node", "_leaves")]
        placed = _met(rows, state, nodes, "left").select(
            *kept,
            F.when((F.col("_leaves") == 1) | left, F.col("_node")).otherwise(F.col("_node") + half).alias("_node"),
            F.when(F.col("_leaves") == 1, 1).when(left, half).otherwise(F.col("_leaves") - half).alias("_leaves"),
        )
        rows = stored(placed, "shard-rows")
    return rows


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    metadata: tuple[str, ...] = ("source", "lang", "doc_id"),
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row per row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 8; null texts count as empty. Shards hold near equal sums of it, each
    the rows of one box of the metadata, numbered by ``slot`` from 0 without gaps. Give the number of shards, or
    ``target_bytes``: then as many as keep shards at or under it. Metadata columns that the table lacks are left
    out; the length of the text is a dimension too. Null metadata come before all others. Rows equal in the metadata are
    split by a hash of id, text and place in the table, so any number of copies can be split. Texts among the metadata are
    ordered by their bytes, whatever they share; infinite numbers count as very large. An empty table gives no rows.
    """
    text = F.col(text_column)
    dimensions, texts = {"_length": utf8_bytes(text).cast("double")}, {}
    for i, name in enumerate(m for m in metadata if m in docs.columns):
        kind = docs.schema[name].dataType.simpleString()
        if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            number = F.col(name).cast("double")
            number = F.when(F.isnan(number), None).when(number > FAR, FAR).when(number < -FAR, -FAR).otherwise(number)
            dimensions[f"_of{i}"] = number
        else:
            texts[f"_of{i}"] = F.col(name).cast("string")
    content = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("_id"),
        (utf8_bytes(text) + 8).alias("_weight"),
        F.crc32(content.cast("binary")).alias("_crc"),
        F.xxhash64(F.col(id_column), content).alias("_hash"),
        *[value.alias(name) for name, value in dimensions.items()],
        *[value.alias(f"{name}_text") for name, value in texts.items()],
    )
    rows = stored(rows, "shard-rows")
    lies = rows.metadataColumn("_metadata")
    # The task that wrote a row and its place there tell repeated rows apart.
    place = F.split_part(lies["file_name"], F.lit("-"), F.lit(2)).cast("long"), lies["row_index"]
    rows = rows.withColumn("_hash", F.xxhash64("_hash", *place))
    rows = rows.withColumn("_tie", F.shiftrightunsigned("_hash", 11).cast("double"))
    least = [F.min(name) for name in dimensions]
    count, weight, *least = rows.agg(F.count(F.lit(1)), F.sum("_weight"), *least).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, math.ceil((weight or 0) / target_bytes))
    rows = rows.fillna({name: (low or 0.0) - 1 for name, low in zip(dimensions, least, strict=True)})
    for name in texts:
        rows = ranked(rows, f"{name}_text", name, count).drop(f"{name}_text")
    if texts and count:
        rows = stored(rows, "shard-rows")
    # In the order of ``metadata``, the length first.
    names = ["_length", *sorted(name for name in rows.columns if name.startswith("_of"))]
    placed = grow(rows, names, shards if count else 1)
    placed = placed.select("_id", "_weight", "_crc", "_hash", F.col("_node").alias("_shard"))
    numbered = gapless(placed, "_shard", "_hash", ["_id", "_crc"], count, "slot")
    return numbered.select(
        F.col("_id").alias(id_column),
        F.col("_weight").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        "slot",
    )
