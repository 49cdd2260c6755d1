"""Quality rules on repetition: maximal repeated word sequences from suffix arrays.

The words of many documents share one suffix array: every word number carries its document, so suffixes of one
document stand together and no repeat crosses a border. The array comes from prefix doubling, and the longest
common prefix of neighbours from the ranks of every third doubling. A suffix lies in the LCP interval of the
larger of its two neighbours' values: that is the longest maximal repeat starting there.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.session import ship_package

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
# Words handled by one suffix array; a longer document has one of its own.
BATCH_WORDS = 250_000
# Bytes of a text that are cut into words at a time; doublings from one kept rank to the next.
PIECE_BYTES = 1 << 20
KEPT_EVERY = 3
BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class RepetitionLimits:
    """Shortest repeat that counts, in words; largest covered fraction; longest repeat allowed."""

    min_words: int = 4
    covered_fraction: float = 0.4
    longest: int = 200


COLUMNS = T.StructType(
    [
        *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("n_covered_words", T.LongType()),
        T.StructField("longest_repeat", T.LongType()),
    ]
)


def word_numbers(data: bytes) -> np.ndarray:
    """A number for each word of a text, the same for equal words; the words of one piece are held at a time."""
    number: dict[bytes, int] = {}
    parts, start = [np.zeros(0, dtype=np.int32)], 0
    while start < len(data):
        blank = BLANK.search(data, start + PIECE_BYTES)
        stop = blank.start() if blank else len(data)
        words = data[start:stop].split()
        parts.append(np.fromiter((number.setdefault(word, len(number)) for word in words), dtype=np.int32, count=len(words)))
        start = stop
    return np.concatenate(parts)


def doubled_ranks(keys: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``keys`` and, for k = 0, ``KEPT_EVERY``, ..., ranks equal where 2**k words are equal within a document.

    A sequence that a document's end cuts off equals no other. Ranks of every third doubling are kept, in four bytes.
    """
    n = len(keys)
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int32)
    del keys
    levels, step, doublings = [rank], 1, 0
    end = np.searchsorted(document, document, side="right").astype(np.int32)
    while True:
        # Where two sequences of the length so far follow each other; those that do not are the last of a document.
        follows = np.arange(step, n + step, dtype=np.int32) < end
        pair = rank.astype(np.int64) * (n + 1)
        at = np.flatnonzero(follows)
        pair[at] += rank[at + step] + 1
        del at
        order = np.argsort(pair, kind="stable").astype(np.int32)
        pair = pair[order]
        fresh = np.ones(n, dtype=bool)
        # Cut-off sequences are told apart; the first in the text sorts first.
        fresh[1:] = (pair[1:] != pair[:-1]) | ~follows[order][1:]
        del pair
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.cumsum(fresh, dtype=np.int32) - 1
        step, doublings = 2 * step, doublings + 1
        if doublings % KEPT_EVERY == 0:
            levels.append(rank)
        if fresh.all():
            return order, levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix, in words, of each suffix with the one before it in the suffix array."""
    n = len(order)
    length = np.zeros(n, dtype=np.int32)
    for number in range(len(levels) - 1, -1, -1):
        words, level = 1 << (number * KEPT_EVERY), levels[number]
        # Pairs whose prefix may be longer yet; each level extends one as often as those above it left room for.
        open_pairs = np.arange(1, n, dtype=np.int32)
        while len(open_pairs):
            left, right = order[open_pairs - 1] + length[open_pairs], order[open_pairs] + length[open_pairs]
            inside = np.maximum(left, right) < n
            open_pairs, left, right = open_pairs[inside], left[inside], right[inside]
            open_pairs = open_pairs[level[left] == level[right]]
            length[open_pairs] += words
    return length


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in the union of the spans."""
    edges = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def repetition(numbers: list[np.ndarray], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document, given as its word numbers: words in repeated windows, words covered by maximal repeats, longest repeat."""
    documents, counts = len(numbers), [len(own) for own in numbers]
    n = sum(counts)
    if not n:
        zero = np.zeros(documents, dtype=np.int64)
        return zero, zero, zero
    document = np.repeat(np.arange(documents, dtype=np.int32), counts)
    order, levels = doubled_ranks(document.astype(np.int64) * (n + 1) + np.concatenate(numbers), document)
    neighbour = neighbour_prefixes(order, levels)
    del levels
    repeat = np.zeros(n, dtype=np.int32)
    repeat[order] = np.maximum(neighbour, np.append(neighbour[1:], np.int32(0)))
    windows = np.flatnonzero(repeat >= WINDOW)
    maximal = np.flatnonzero(repeat >= min_words)

    def by_document(covered: np.ndarray) -> np.ndarray:
        return np.bincount(document[covered], minlength=documents)

    in_windows = by_document(_covered(windows, repeat[windows], n))
    in_repeats = by_document(_covered(maximal, repeat[maximal], n))
    longest = np.zeros(documents, dtype=np.int64)
    np.maximum.at(longest, document, repeat)
    return in_windows, in_repeats, longest


def measure(texts: list[str | None], min_words: int) -> dict[str, list[int]]:
    """The columns of ``COLUMNS`` for each text."""
    out: dict[str, list[int]] = {name: [] for name in COLUMNS.names}
    numbers: list[np.ndarray] = []
    waiting = 0

    def flush() -> None:
        for name, values in zip(("n_repeat_words", "n_covered_words", "longest_repeat"), repetition(numbers, min_words), strict=True):
            out[name].extend(values.tolist())
        numbers.clear()

    for text in texts:
        data = (text or "").encode()
        own = word_numbers(data)
        lines, different = 0, set()
        for line in io.BytesIO(data):
            if line.strip():
                lines += 1
                different.add(line.removesuffix(b"\n"))
        out["n_words"].append(len(own))
        out["word_chars"].append(len(text or "") - (len(data) - len(data.translate(None, WHITE))))
        out["n_symbols"].append(len(data) - len(data.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(lines - len(different))
        if numbers and waiting + len(own) > BATCH_WORDS:
            flush()
            waiting = 0
        numbers.append(own)
        waiting += len(own)
    flush()
    return out


def judged(docs: DataFrame, text_column: str = "text", limits: RepetitionLimits = RepetitionLimits(), carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default), the measures, ``base_failed`` and ``kept``; one row per row of ``docs``.

    Base rules: at least 20 words, and at most 30 % of the words in 8-word windows found twice. The verdict: maximal
    repeats of ``min_words`` or more cover at most ``covered_fraction`` of the words and none is longer than
    ``longest``. A null text has no words and fails; repeated rows are judged alike; an empty table gives no rows. A
    measure replaces a carried column of its name.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*COLUMNS.names, "base_failed", "kept")]
    fields = [*docs.select(*[F.col(f"`{c}`") for c in carry]).schema.fields, *COLUMNS.fields]
    names, min_words, measured_text = COLUMNS.names, limits.min_words, "_measured"
    while measured_text in carry:
        measured_text += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(measured_text).to_pylist(), min_words)
            kept = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[n], pa.int64()) for n in names]], [*carry, *names])

    ship_package(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_column).alias(measured_text))
    measured = source.mapInArrow(run, T.StructType(fields))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    repetitive = (F.col("n_covered_words") > limits.covered_fraction * F.col("n_words")) | (F.col("longest_repeat") > limits.longest)
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & ~repetitive)
