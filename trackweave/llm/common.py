"""Helpers shared by the operators of this folder: working folders, stable row locators, joins that
survive hot keys, gapless numbering."""

from __future__ import annotations

import math
import string
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.session import shared_dir

# A key is hot if it holds more than this share of the rows, so there are fewer than 1/share hot keys.
HOT_SHARE = 1 / 1000
# Rows of one numbering block; a block is numbered by one task.
BLOCK_ROWS = 100_000


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/trackweave-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, lost executors recompute nothing before it."""
    folder = working_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the fast path holds where all characters are one byte."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` as a plain Parquet scan, so that its rows have locators; stored first if it is none."""
    try:
        # Not the column of that name which a table may have of its own.
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return docs
    except AnalysisException:
        return stored(docs, "documents")


def located(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``columns`` next to ``_file`` and ``_row``: where each row lies in the Parquet files.

    The locator is the same at every scan and differs between repeated rows. ``_split`` is where the split starts in
    which a scan reads the row.
    """
    docs = scanned(docs)
    lies = docs.metadataColumn("_metadata")
    named = [column.alias(name) for name, column in columns.items()]
    return docs.select(
        *named,
        lies["file_path"].alias("_file"),
        lies["row_index"].alias("_row"),
        lies["file_block_start"].alias("_split"),
    )


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """``left`` joined to ``right``, which has each key once and in ``weight`` how many rows of ``left`` it meets.

    Keys that meet more than a thousandth of the ``total`` rows, fewer than a thousand keys, travel to the rows by
    broadcast; the others are shuffled and none of them is large. Keys are compared null-safely.
    """
    if how not in ("left", "inner"):
        raise ValueError("left and inner joins only")
    floor = max(1, math.floor(total * HOT_SHARE))
    names = {key: f"_hot_{i}" for i, key in enumerate(keys)}
    values = [c for c in right.columns if c not in keys]
    hot = right.filter(F.col(weight) > floor).select(
        *[F.col(key).alias(name) for key, name in names.items()], F.struct(*values).alias("_of_hot")
    )
    on_hot = [left[key].eqNullSafe(hot[name]) for key, name in names.items()]
    marked = left.join(F.broadcast(hot), on_hot, "left").drop(*names.values())
    met = marked.filter(F.col("_of_hot").isNotNull()).select(*left.columns, "_of_hot.*")
    rest = marked.filter(F.col("_of_hot").isNull()).drop("_of_hot")
    cold = right.filter(F.col(weight) <= floor).select(
        *[F.col(key).alias(name) for key, name in names.items()], *values
    )
    on_cold = [rest[key].eqNullSafe(cold[name]) for key, name in names.items()]
    return met.unionByName(rest.join(cold, on_cold, how).drop(*names.values()))


def gapless(df: DataFrame, group: str, order: str, ties: list[str], total: int, output: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in bounded tasks.

    ``order`` is a hash: rows are dealt to blocks by its top bits, counted per block, and numbered
    inside their block from where the blocks before it end. ``ties`` order rows of one hash.
    """
    bits = max(0, math.ceil(math.log2(max(1, total) / BLOCK_ROWS)))
    # The hash as an unsigned number, so that blocks follow its order.
    block = F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    dealt = df.withColumn("_block", block)
    counts = dealt.groupBy(group, "_block").count()
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_block").orderBy(order, *ties)
    numbered = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, [group, "_block"])
    return joined.withColumn(output, (F.col("_start") + F.col("_in")).cast("long")).drop("_block", "_start", "_in")
