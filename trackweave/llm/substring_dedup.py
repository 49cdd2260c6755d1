"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes; at the end of every word it sums up the last ``WINDOW`` bytes. A chunk ends at the
word whose hash is the largest within ``REACH`` words on either side, so borders depend on the nearby text only
and an insertion moves none but those next to it. Tokens of more than ``LONG_TOKEN`` bytes, such as passages in scripts
without spaces, are words of their own about every ``PIECE`` characters, where the hash says so. Chunks are deduplicated by digest: each stays in the document with
the smallest id that holds it. Elsewhere it goes, but only in runs of repeated chunks that are long enough
to be a passage and not a common phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import join_hot, stored
from trackweave.session import ship_package

WINDOW = 16
REACH = 3
MIN_WORDS = 20
LONG_TOKEN = 64
PIECE = 8
FILTER_BITS = 27
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte the sum of the gears of the ``WINDOW`` bytes that end there, each shifted by its distance."""
    total, span = GEAR[data], 1
    while span < WINDOW:
        # The window of twice the length, from two neighbouring ones.
        longer = total.copy()
        longer[span:] += total[:-span] << np.uint32(span)
        total, span = longer, 2 * span
    return total


def word_ends(array: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which bytes are the last of a word, or in a long token of a character whose hash makes it the last of a piece."""
    white = IS_WHITE[array]
    ends = ~white & np.append(white[1:], True)
    first = np.flatnonzero(~white & np.insert(white[:-1], 0, True))
    last = np.flatnonzero(ends)
    long = last - first >= LONG_TOKEN
    if long.any():
        border = np.zeros(len(array), dtype=np.int8)
        border[first[long]], border[last[long]] = 1, -1
        inside = np.cumsum(border, dtype=np.int8).view(bool)
        whole = np.append(array[1:] & 0xC0 != 0x80, True)
        # Bits from the middle, which the largest value does not depend on.
        ends |= inside & whole & ((value >> np.uint32(16)) % np.uint32(PIECE) == 0)
    return np.flatnonzero(ends)


def chunk_ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the chunks of a text end, and the number of words in each; none without words."""
    array = np.frombuffer(data, dtype=np.uint8)
    if not len(array):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # Spread over all bits, since the newest byte alone decides the lowest.
    value = gear_hashes(array) * np.uint32(2654435761)
    last = word_ends(array, value)
    if not len(last):
        return last, last
    value = value[last]
    cut = np.ones(len(value), dtype=bool)
    for step in range(1, REACH + 1):
        cut[step:] &= value[step:] > value[:-step]
        cut[:-step] &= value[:-step] >= value[step:]
    cut[-1] = True
    at = np.flatnonzero(cut)
    return last[at] + 1, np.diff(at, prepend=-1)


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest halves, words, whether it is the text's first chunk of that digest) per chunk."""
    data = (text or "").encode()
    ends, words = chunk_ends(data)
    stops = ends.tolist()
    digests = [xxhash.xxh3_128_digest(b" ".join(data[a:b].split())) for a, b in zip([0, *stops], stops)]
    seen: set[bytes] = set()
    first = [not (d in seen or seen.add(d)) for d in digests]
    halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return halves, words, np.array(first, dtype=bool)


def _repeated_bits(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit set for every digest found more than once (and by chance for a few others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [chunks(text.as_py())[0][:, 0] for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(halves) if halves else np.zeros(0, np.int64))], ["half"])

    bit = F.shiftrightunsigned("half", 64 - FILTER_BITS)
    found = rows.select("_text").mapInArrow(run, "half long").groupBy("half").count().filter(F.col("count") > 1)
    mask = F.expr("shiftleft(1L, int(bit & 63))")
    words = found.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    table = words.toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[table.column("word").to_numpy()] = table.column("mask").to_numpy()
    return bits.view(np.uint64)


def _marks(rows: DataFrame) -> DataFrame:
    """``_key, _id, _marks``: per text its chunks that are kept elsewhere, as (place, words, id of the holder)."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(_repeated_bits(rows))
    id_type = rows.schema["_id"].dataType
    schema = T.StructType(
        [
            T.StructField("_id", id_type),
            T.StructField("_key", T.LongType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("words", T.IntegerType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("high", T.LongType()),
            T.StructField("low", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, counts = [], []
            for text in batch.column("_text"):
                halves, words, first = chunks(text.as_py())
                bit = halves[:, 0].view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                place = np.flatnonzero(bits.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                parts.append((place, words[place], first[place], halves[place]))
                counts.append(len(place))
            if not sum(counts):
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            place, words, first, halves = (np.concatenate(column) for column in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(row)),
                    batch.column("_key").take(pa.array(row)),
                    pa.array(place, pa.int32()),
                    pa.array(words, pa.int32()),
                    pa.array(first),
                    pa.array(np.ascontiguousarray(halves[:, 0])),
                    pa.array(np.ascontiguousarray(halves[:, 1])),
                ],
                schema.names,
            )

    found = stored(rows.select("_id", "_key", "_text").mapInArrow(run, schema), "chunks")
    bits.unpersist()
    held = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("holder"))
    met = join_hot(found, held.filter("n > 1"), ["high", "low"], "n", found.count(), "inner")
    gone = met.filter(~(F.col("_id").eqNullSafe(F.col("holder")) & F.col("first")))
    # Repeated rows share a key and what is found for them.
    marks = gone.groupBy("_id", "_key").agg(F.collect_set(F.struct("place", "words", "holder")).alias("_marks"))
    enough = F.aggregate("_marks", F.lit(0), lambda n, mark: n + mark["words"]) >= MIN_WORDS
    return marks.filter(enough)


def runs(marks: list[dict], min_words: int = MIN_WORDS) -> list[tuple[int, int, int, set]]:
    """(first chunk, last chunk, words, holders) of the runs of neighbouring marked chunks that are long enough."""
    found: list[tuple[int, int, int, set]] = []
    for mark in sorted(marks, key=lambda m: m["place"]):
        place, words = mark["place"], mark["words"]
        if found and found[-1][1] == place - 1:
            start, _, before, holders = found.pop()
            found.append((start, place, before + words, holders | {mark["holder"]}))
        else:
            found.append((place, place, words, {mark["holder"]}))
    return [run for run in found if run[2] >= min_words]


def cut(text: str, found: list[tuple[int, int, int, set]]) -> tuple[str, list[dict]]:
    """The text without the runs, and their places in it in UTF-8 bytes."""
    data = text.encode()
    ends = chunk_ends(data)[0]
    spans = [(int(ends[first - 1]) if first else 0, int(ends[last])) for first, last, _, _ in found]
    edges = [0, *[edge for span in spans for edge in span], len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return kept.decode(), [{"start": a, "end": b} for a, b in spans]


def without_repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text cut, and ``removed_words long``, ``removed_spans array<struct<start, end>>``, ``held_by array``.

    A passage of ``MIN_WORDS`` or more words in whole chunks that other documents hold too stays in the one with the smallest
    id; ``held_by`` lists the ids of those that keep what was cut here, spans are UTF-8 byte offsets in the whole text.
    A token of more than ``LONG_TOKEN`` bytes counts a word for each of its pieces, and is cut between characters.
    Passages repeated inside a text stay once. Rows with the same id count as one document; a null id is larger than all
    others, and rows with null ids count as one. A null text stays null and an empty one empty; an empty table gives
    no rows. Columns of the three names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    names = [c for c in docs.columns if c not in ("removed_words", "removed_spans", "held_by")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"),
        F.col(id_column).alias("_id"),
        F.col(text_column).alias("_text"),
        F.xxhash64(text_column).alias("_key"),
    )
    marks = _marks(rows.select("_id", "_key", "_text"))
    marks = marks.select(F.col("_id").alias("_of"), F.col("_key").alias("_of_key"), "_marks")
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_of_key"))
    joined = rows.select("_doc", "_id", "_key").join(marks, same, "left")
    id_type = docs.schema[id_column].dataType
    told = T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("removed_words", T.LongType()),
            T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("held_by", T.ArrayType(id_type)),
        ]
    )
    schema = T.StructType([T.StructField("_doc", rows.schema["_doc"].dataType), *told.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("_doc")
            texts = doc.field(doc.type.get_field_index(text_column))
            columns: dict[str, list] = {name: [] for name in told.names}
            for text, marked in zip(texts.to_pylist(), batch.column("_marks").to_pylist(), strict=True):
                found = runs(marked or [])
                kept, spans = cut(text, found) if found else (text, [])
                columns["text"].append(kept)
                columns["removed_words"].append(sum(run[2] for run in found))
                columns["removed_spans"].append(spans)
                holders = set().union(*[run[3] for run in found])
                columns["held_by"].append(sorted(holders, key=lambda i: (i is None, i)))
            types = [pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), None]
            arrays = [pa.array(columns[n], t) if t else _lists(columns[n], batch.column("_id").type) for n, t in zip(told.names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([doc, *arrays], ["_doc", *told.names])

    done = joined.select("_doc", "_id", "_marks").mapInArrow(run, schema)
    cut_text: list[Column] = [
        F.col("text").alias(c) if c == text_column else F.col("_doc")[c].alias(c) for c in names
    ]
    return done.select(*cut_text, "removed_words", "removed_spans", "held_by")


def _lists(values: list[list], item: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(item))
