"""BPE encoding and decoding through a table of distinct words.

Texts stay in blocks of neighbouring rows, cut by summed bytes. A text is split into words once; what travels on is the
number of each word in its block, and per block the distinct words themselves, so the shuffle grows with the
numbers and the distinct words, not with the texts. The word table is dealt by the hash of the word: its buckets encode each
distinct word once and answer every block. In its block every text joins its words to their identifiers by position, and
these to their pieces.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.bpe import merge
from trackweave.llm.common import located
from trackweave.session import ship_package

# The pattern that cuts texts before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 16 << 20
PART_BYTES = 4 << 20
SIGNED = {"uint16": "int16", "int32": "int32"}


def byte_alphabet() -> list[str]:
    """A visible character for each byte: itself if it is visible, else one of those from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in visible else next(hidden) for b in range(256)]


class WordCodec:
    """A byte-level vocabulary with merges and special tokens, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.ids: dict[str, int] = told["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = {token["content"]: token["id"] for token in told["added_tokens"]}
        self.id_type = "uint16" if max([*self.ids.values(), *self.special.values()]) < 1 << 16 else "int32"
        self.letters = byte_alphabet()
        self.word = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def words(self, text: str) -> list[str]:
        if self.mark is None or not any(name in text for name in self.special):
            return self.word.findall(text)
        found: list[str] = []
        for part in self.mark.split(text):
            found += [part] if part in self.special else self.word.findall(part)
        return found

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        symbols = [self.letters[b] for b in word.encode()]
        return [self.ids[s] for s in merge(symbols, lambda a, b: self.ranks.get((a, b)))]

    def pieces(self) -> list[tuple[int, bytes]]:
        """Bytes of every identifier."""
        byte = {letter: b for b, letter in enumerate(self.letters)}
        plain = {i: bytes(byte[c] for c in piece) for piece, i in self.ids.items()}
        return sorted((plain | {i: name.encode() for name, i in self.special.items()}).items())


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def ship(words: list[str]) -> tuple[str, np.ndarray]:
    return "".join(words), np.array([len(word) for word in words], dtype=np.int32)


def unship(letters: str, lengths: list[int]) -> list[str]:
    ends = np.cumsum(lengths).tolist()
    return [letters[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def bucket_of(word: str, buckets: int) -> int:
    return xxhash.xxh32_intdigest(word.encode()) % buckets


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
    """``block, row in its batch, text``. A block ends with its split, or when its texts hold ``BLOCK_BYTES``; splits are read
    in the same order each time, so every scan cuts the same blocks."""
    where, number, held, block = None, 0, 0, 0
    for batch in batches:
        for row, (split, text) in enumerate(zip(batch.column("_where").to_pylist(), batch.column("_text"), strict=True)):
            if split != where or held >= BLOCK_BYTES:
                number = number + 1 if split == where else 0
                where, held = split, 0
                block = xxhash.xxh64_intdigest(f"{where} {number}".encode()) - (1 << 63)
            held += text.as_buffer().size
            yield block, row, text.as_py()


def numbered(content: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of two kinds, by where they go.

    To a bucket of the word table go a block's distinct words of that bucket, in order; to the block go its texts as numbers
    of words, in compressed parts of bounded size (a longer text is one part), and how many distinct words it has. The
    number of a word is its place among them, bucket after bucket.
    """
    id_type = content.schema["_id"].dataType
    schema = T.StructType(
        [T.StructField("_to", T.LongType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType())]
        + [T.StructField("letters", T.StringType()), T.StructField("lengths", T.ArrayType(T.IntegerType()))]
        + [T.StructField("ids", T.ArrayType(id_type)), T.StructField("codes", T.BinaryType()), T.StructField("words", T.IntegerType())]
    )

    def rows_of(block: int, number: dict[str, int], held: list, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list[str]] = {}
        for word in sorted(number):
            dealt.setdefault(bucket_of(word, buckets), []).append(word)
        place = np.zeros(len(number), dtype=np.int32)
        place[[number[word] for bucket in sorted(dealt) for word in dealt[bucket]]] = np.arange(len(number))
        press, part, size = zstandard.ZstdCompressor(), [], 0
        rows = [(target("bucket", k), block, k, *ship(words), None, None, None) for k, words in dealt.items()]

        def texts() -> tuple:
            joined = np.concatenate([place[codes] for _, codes in part])
            # Low bytes and high bytes apart compress better.
            planes = joined.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
            lengths = np.array([len(codes) for _, codes in part], dtype=np.int32)
            return block, block, None, None, lengths, [own for own, _ in part], press.compress(planes), len(number)

        for own, codes in held:
            if part and size >= PART_BYTES:
                rows.append(texts())
                part, size = [], 0
            part.append((own, codes))
            size += codes.nbytes
        rows.append(texts())
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(id_kind), pa.binary(), pa.int32()]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, held, current, own, id_kind = codec(path), [], None, [], None
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal own, id_kind
            for batch in batches:
                own, id_kind = batch.column("_id").to_pylist(), batch.column("_id").type
                yield batch

        for block, row, text in by_block(watched()):
            if block != current and held:
                yield from rows_of(current, number, held, id_kind)
                held = []
                number.clear()
            current = block
            held.append((own[row], np.array([number[word] for word in used.words(text)], dtype=np.int32)))
        if held:
            yield from rows_of(current, number, held, id_kind)

    return content.select("_where", "_id", "_text").mapInArrow(run, schema)


def target(kind: str, number: int) -> int:
    """Where rows of a bucket meet: a number as those of the blocks are."""
    return xxhash.xxh64_intdigest(f"{kind} {number}".encode()) - (1 << 63)


def encoded_words(dealt: DataFrame, path: str) -> DataFrame:
    """The word table, bucket by bucket: each distinct word is encoded once, and every block that asked gets its answer.

    A bucket holds a row for each block, however frequent a word is. An answer has the identifiers of the asked words in
    their order, two bytes each if the vocabulary allows. Texts that lie in the same partition pass by unread.
    """
    kind = codec(path).id_type
    shipped = SIGNED[kind]

    def encode(table: pa.Table) -> pa.Table:
        used, known = codec(path), {}
        asked = table.filter(pc.is_valid(table.column("bucket")))
        ids, counts = [], []
        for letters, lengths in zip(asked.column("letters").to_pylist(), asked.column("lengths").to_pylist(), strict=True):
            row, sizes = [], []
            for word in unship(letters, lengths):
                if word not in known:
                    known[word] = used.encode(word)
                row += known[word]
                sizes.append(len(known[word]))
            ids.append(np.array(row, dtype=kind).view(shipped))
            counts.append(np.array(sizes, dtype=np.int32))
        columns = [asked.column("block"), asked.column("bucket")]
        columns += [pa.array(ids, pa.list_(pa.from_numpy_dtype(shipped))), pa.array(counts, pa.list_(pa.int32()))]
        return pa.table(columns, names=["_to", "bucket", "ids", "counts"])

    element = "short" if kind == "uint16" else "int"
    return dealt.groupBy("_to").applyInArrow(encode, f"_to long, bucket int, ids array<{element}>, counts array<int>")


def encode_and_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: one row per row of ``docs``; its token identifiers, and the text they decode to.

    ``path`` is a byte-level vocabulary that the executors can read. Its special tokens are recognised in texts. A null or
    empty text has no identifiers and decodes to an empty text; repeated rows are encoded each; an empty table gives no
    rows. Blocks hold about ``BLOCK_BYTES`` of text or one longer text. The words are held by a bucket, and the blocks met by
    a task, per ``BLOCK_BYTES`` of the table. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    content = located(docs, {"_id": F.col(id_column), "_text": F.coalesce(F.col(text_column), F.lit(""))})
    size = content.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BLOCK_BYTES))
    content = content.select(F.xxhash64("_file", "_split").alias("_where"), "_id", "_text")
    # One shuffle holds words and texts; both that read it group by the same column, so it is made once.
    dealt = numbered(content, path, buckets).repartition(buckets, "_to")
    answers = encoded_words(dealt, path).repartition(buckets, "_to")
    # A piece for each identifier of the vocabulary; decoding joins them by identifier.
    pieces = spark.sparkContext.broadcast(codec(path).pieces())
    schema = T.StructType(
        [
            T.StructField("_id", docs.schema[id_column].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def look_up(parts: pa.Table, answers: pa.Table) -> pa.Table:
        expand, parts = zstandard.ZstdDecompressor(), parts.filter(pc.is_null(parts.column("bucket")))
        spans = _table(answers, max(parts.column("words").to_pylist(), default=0), codec(path).id_type)
        piece = dict(pieces.value)
        by_id = [piece.get(i, b"") for i in range(max(piece, default=-1) + 1)]
        all_ids, decoded = [], []
        for lengths, packed in zip(parts.column("lengths").to_pylist(), parts.column("codes").to_pylist(), strict=True):
            planes = np.frombuffer(expand.decompress(packed), np.uint8).reshape(4, -1)
            joined = np.ascontiguousarray(planes.T).view("<i4").ravel()
            ends = np.cumsum(lengths).tolist()
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                ids = _listed(joined[start:end], spans)
                all_ids.append(ids)
                decoded.append(b"".join([by_id[i] for i in ids.tolist()]).decode(errors="replace"))
        offsets = pa.array(np.cumsum([0, *[len(ids) for ids in all_ids]]), pa.int32())
        values = pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, dtype=np.int32), pa.int32())
        own = parts.column("ids").combine_chunks().flatten()
        return pa.table([own, pa.ListArray.from_arrays(offsets, values), pa.array(decoded, pa.string())], names=schema.names)

    both = dealt.groupBy("_to").cogroup(answers.groupBy("_to"))
    return both.applyInArrow(look_up, schema).withColumnRenamed("_id", id_column)


Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def _listed(at: np.ndarray, spans: Spans) -> np.ndarray:
    """The stretches of identifiers with the numbers ``at``, one after another."""
    start, length, flat = spans
    n = length[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[at] - (ends - n), n) + np.arange(total)]


def _table(answers: pa.Table, words: int, kind: str) -> Spans:
    """By the number of a word: where its identifiers start, how many they are; and all identifiers.

    Words are numbered bucket after bucket, so the answers in that order need not repeat them.
    """
    answers = answers.sort_by("bucket")
    counts, ids = answers.column("counts").combine_chunks(), answers.column("ids").combine_chunks()
    length = counts.flatten().to_numpy().astype(np.int64)
    if len(length) != words:
        raise RuntimeError("a block has more or fewer answers than distinct words")
    flat = ids.flatten().to_numpy().view(kind).astype(np.int32)
    return np.cumsum(length) - length, length, flat
