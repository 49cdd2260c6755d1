"""Token counts by byte-pair merging, without token identifiers.

A text has as many tokens as it has symbols at first less the merges made. Pieces never go on past the
space mark that starts the next word, so a text is cut there and every word is merged on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.bpe import count_merges
from trackweave.session import ship_package

MARK = "▁"
TOKEN_LIMIT = 4096
# Counts of words remembered by a worker, and the longest word remembered.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64


class PieceCounter:
    """Counts the tokens of a piece model whose pieces have scores and whose unknown characters become bytes."""

    def __init__(self, pieces: dict[str, float]):
        inner = [piece for piece in pieces if MARK in piece.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with a space mark inside: {inner[:3]}")
        self.pieces = pieces
        longer = [piece for piece in pieces if len(piece) > 1]
        # Characters of no longer piece end words as well; the line feed is the one that matters.
        self.ends = "" if any("\n" in piece for piece in longer) else "\n"
        self.word = re.compile(rf"{MARK}*[^{MARK}{self.ends}]+|{MARK}+" + (rf"|{self.ends}" if self.ends else ""))
        self.known: dict[str, int] = {}

    @staticmethod
    def from_model(path: str) -> PieceCounter:
        return _model(path)

    def _priority(self, left: str, right: str) -> float | None:
        score = self.pieces.get(left + right)
        return None if score is None else -score

    def of_word(self, word: str) -> int:
        symbols = sum(1 if c in self.pieces else len(c.encode()) for c in word)
        return symbols - count_merges(list(word), self._priority)

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for word in self.word.findall(MARK + text.replace(" ", MARK)):
            n = known.get(word)
            if n is None:
                n = self.of_word(word)
                if len(word) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _model(path: str) -> PieceCounter:
    """A model that marks spaces, adds one in front, changes no character and has bytes for unknown ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    probe = " a  Åﬁ\n"
    if model.normalize(probe) != MARK + probe.replace(" ", MARK) or any(map(model.is_unused, plain)):
        raise ValueError(f"{path}: its normalisation or unused pieces are not supported")
    return PieceCounter({model.id_to_piece(i): model.get_score(i) for i in plain})


def token_counts(
    docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per row of ``docs``.

    ``model`` is the path of a piece model that the executors can read. A null or empty text has no tokens; strings of
    special tokens are ordinary text; repeated rows are counted each; an empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField("_id", docs.schema[id_column].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.from_model(model)
        for batch in batches:
            counts = [counter.of_text(text.as_py()) for text in batch.column("_text")]
            arrays = [batch.column("_id"), batch.column("_bytes"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    ship_package(docs.sparkSession)
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("_bytes")
    source = docs.select(F.col(id_column).alias("_id"), size, F.col(text_column).alias("_text"))
    counted = source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return counted.withColumnRenamed("_id", id_column)
