"""Packing into padded batches: length buckets that waste least, and token-budget batches inside each of them.

The lengths of all texts are counted in one histogram; dynamic programming over it chooses the bucket boundaries with
the least padding among the candidates: every length below ``EXACT_BELOW``, above it the largest length of each bin. So
beyond ``EXACT_BELOW`` the result is the optimum only to within one part in 512 of a text's padded length. A text is padded to its bucket's boundary, so a batch of a bucket holds as many texts as the budget
has room for boundaries.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import gapless, stored

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 16
BATCH_TOKENS = 65_536
# Lengths below this are boundaries of their own; above it a boundary is chosen among 512 an octave.
EXACT_BELOW = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_bin(length: Column, exact_below: int = EXACT_BELOW) -> Column:
    """The length itself, or beyond ``exact_below`` only its leading bits."""
    bits = int(math.log2(exact_below))
    octave = F.length(F.bin(length)) - 1
    drop = F.greatest(octave - (bits - 1), F.lit(0))
    step = F.pow(F.lit(2), drop).cast("long")
    return F.when(length < exact_below, length).otherwise(F.floor(length / step).cast("long") * step)


def histogram(lengths: DataFrame, column: str, exact_below: int = EXACT_BELOW) -> list[tuple[int, int]]:
    """(largest length, rows) per bin in ascending order: a few thousand bins at most for any table."""
    bins = lengths.groupBy(length_bin(F.col(column), exact_below).alias("bin"))
    found = bins.agg(F.max(column).alias("length"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((row["length"], row["n"]) for row in found)


def best_boundaries(bins: list[tuple[int, int]], buckets: int) -> list[int]:
    """Boundaries of at most ``buckets`` buckets with the least total padding; the last is the largest length.

    Total padding is the sum of boundary times rows less the sum of the lengths, and the latter is fixed. Of
    equally good choices the one with fewer buckets is taken.
    """
    if not bins:
        return []
    length = np.array([b[0] for b in bins], dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum([b[1] for b in bins], dtype=np.float64)])
    n = len(bins)
    # best[j]: least padded tokens for the first j bins with as many buckets as rounds done.
    best = np.concatenate([[0.0], length * rows[1:]])
    choices = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        following, chosen = best.copy(), np.full(n + 1, -1, dtype=np.int64)
        for j in range(1, n + 1):
            costs = best[:j] + length[j - 1] * (rows[j] - rows[:j])
            i = int(costs.argmin())
            if costs[i] < following[j]:
                following[j], chosen[j] = costs[i], i
        best = following
        choices.append(chosen)
    boundaries, j, k = [], n, len(choices) - 1
    while j > 0:
        while choices[k][j] < 0:  # no gain from one bucket more
            k -= 1
        boundaries.append(int(length[j - 1]))
        j, k = int(choices[k][j]), k - 1
    return boundaries[::-1]


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: Column | None = None,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_length, batch, place, padding``: one row per row of ``docs``.

    ``length`` is the number of tokens, by default of words; nulls count as none. A batch holds rows of one bucket, each
    padded to ``bucket_length``, and at most ``batch_tokens`` tokens with the padding; a longer text has a batch of its
    own. Batches are numbered over all buckets; rows are dealt to them by a hash of id and text, so they are mixed.
    Repeated rows each get a place. Texts without tokens take room for none. An empty table gives no rows.
    """
    n_tokens = F.coalesce((word_count(F.col(text_column)) if length is None else length).cast("long"), F.lit(0))
    order = F.xxhash64(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")))
    rows = docs.select(F.col(id_column).alias("_id"), n_tokens.alias("_n"), order.alias("_order"))
    rows = stored(rows, "lengths")
    bins = histogram(rows, "_n")
    edges = best_boundaries(bins, buckets)
    # Rows per bucket follow from the histogram: a bin lies in one bucket.
    counts = [0] * max(1, len(edges))
    for longest, n in bins:
        counts[next(i for i, edge in enumerate(edges) if longest <= edge)] += n
    capacity = [max(1, batch_tokens // max(1, edge)) for edge in edges] or [1]
    first = [0]
    for count, room in zip(counts, capacity, strict=True):
        first.append(first[-1] + math.ceil(count / room))
    bucket = F.lit(0)
    for edge in edges[:-1]:
        bucket = bucket + F.when(F.col("_n") > edge, 1).otherwise(0)
    placed = gapless(rows.withColumn("_bucket", bucket), "_bucket", "_order", ["_id", "_n"], sum(counts), "_slot")

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]).cast("array<bigint>"), F.col("_bucket") + 1)

    edge, room = of_bucket(edges or [0]), of_bucket(capacity)
    return placed.select(
        F.col("_id").alias(id_column),
        F.col("_n").alias("n_tokens"),
        F.col("_bucket").alias("bucket"),
        edge.alias("bucket_length"),
        (of_bucket(first[:-1]) + F.floor(F.col("_slot") / room)).cast("long").alias("batch"),
        (F.col("_slot") % room).alias("place"),
        (edge - F.col("_n")).alias("padding"),
    )
