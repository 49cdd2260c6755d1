"""JSON-array files read by many tasks, and written in files of bounded size.

A file is read as text whose lines end at ``}``, which Spark splits at any size. Whether such a piece starts inside a
string, and how deep in objects, depends on all before it; so every split first tells how it changes both, for either
answer, the changes are summed along each file, and a second scan cuts the objects. One that crosses the
border of splits comes in parts, which are joined afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.session import materialize, ship_package

ESCAPED = re.compile(r"\\.", re.DOTALL)
# What the second scan finds: an object, a part of one that began in an earlier split, the start of one that goes on in
# later ones, a bracket around the objects, or text that belongs to no such file.
WHOLE, LATER, BEGUN, BRACKET, FAULT = range(5)
CORRUPT = "_corrupt_record"
BATCH_BYTES = 1 << 24


def outside(piece: str, inside: int) -> tuple[int, int]:
    """Braces opened outside of strings in ``piece``, and whether it ends inside one, if it starts ``inside`` one or not."""
    parts = ESCAPED.sub("", piece).split('"')
    return sum(part.count("{") for part in parts[inside::2]), (inside + len(parts) - 1) % 2


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "}").text(path)
    lies = lines.metadataColumn("_metadata")
    return lines.select(
        F.col("value").cast("binary").alias("piece"),
        lies["file_path"].alias("file"),
        lies["file_block_start"].alias("split"),
        lies["file_size"].alias("file_size"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def _summaries(pieces: DataFrame) -> DataFrame:
    """A row per split: its bytes, whether it turns inside and outside of strings about, the depth gained for either start."""
    schema = "file string, split long, file_size long, bytes long, turns int, gain_0 long, gain_1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}  # the splits of one task
        for piece, file, split, size in _rows(batches):
            # bytes, state and depth if it started outside, and if inside
            now = found.setdefault((file, split, size), [0, 0, 0, 1, 0])
            now[0] += len(piece) + 1
            text = piece.decode("utf-8", "replace")
            for at in (1, 3):
                opened, now[at] = outside(text, now[at])
                now[at + 1] += opened - (now[at] == 0)
        rows = [
            {"file": k[0], "split": k[1], "file_size": k[2], "bytes": v[0], "turns": v[1], "gain_0": v[2], "gain_1": v[4]}
            for k, v in found.items()
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema(
        [("file", pa.string()), ("split", pa.int64()), ("file_size", pa.int64()), ("bytes", pa.int64()),
         ("turns", pa.int32()), ("gain_0", pa.int64()), ("gain_1", pa.int64())]
    )
    return pieces.mapInArrow(run, schema)


def _starts(summaries: DataFrame) -> DataFrame:
    """``inside, depth`` where each split starts, ``last`` and ``closed``: whether its file ends with the ``}`` of a piece."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")  # a row per split
    entered = summaries.withColumn("inside", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int"))
    gained = F.when(F.col("inside") == 0, F.col("gain_0")).otherwise(F.col("gain_1"))
    return entered.withColumn("_gain", gained).select(
        F.col("file").alias("_file"),
        F.col("split").alias("_split"),
        "inside",
        F.coalesce(F.sum("_gain").over(before), F.lit(0)).alias("depth"),
        (F.col("split") == F.min("split").over(whole)).alias("first"),
        (F.col("split") == F.max("split").over(whole)).alias("last"),
        # The last piece counted a brace that the file may lack.
        (F.sum("bytes").over(whole) != F.col("file_size") + 1).alias("closed"),
    )


class _Cutter:
    """Cuts the pieces of one split into what they hold."""

    def __init__(self, inside: int, depth: int, first: bool) -> None:
        self.inside, self.depth, self.at_start = inside, depth, first
        self.text, self.kind = [], LATER

    def feed(self, text: str, closed: bool) -> Iterator[tuple[int, str]]:
        """A piece, and whether a ``}`` follows it."""
        if self.depth == 0:
            between, brace, rest = text.partition("{")
            glue = "".join(between.split())
            if brace:
                right = glue in ("", "[") if self.at_start else glue == ","
            else:
                right = not closed and glue in (("", "[]") if self.at_start else ("", "]"))
            if not right:
                yield FAULT, ""
            yield from ((BRACKET, mark) for mark in glue if mark in "[]")
            if not brace:
                return
            self.at_start, self.kind, text = False, WHOLE, brace + rest
        opened, self.inside = outside(text, self.inside)
        self.depth += opened - (closed and self.inside == 0)
        self.text.append(text + "}" if closed else text)
        if self.depth == 0:
            yield self.kind, "".join(self.text)
            self.text = []

    def rest(self, last: bool) -> Iterator[tuple[int, str]]:
        if self.depth:
            yield (FAULT, "") if last else (BEGUN if self.kind == WHOLE else LATER, "".join(self.text))


def _cut(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """``file, split, kind, text``. ``starts`` has a row of some hundred bytes per split of some hundred MB and travels."""
    on = (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split"))
    met = pieces.join(F.broadcast(starts), on).select("piece", "file", "split", "inside", "depth", "first", "last", "closed")
    arrow = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cutter, held, here = None, None, None
        for piece, *where in _rows(batches):
            if cutter is not None:
                # The last piece of the file may end without a brace; any other ends with one.
                over = where != here
                yield from ((*here[:2], *part) for part in cutter.feed(held, not over or not here[5] or here[6]))
                if over:
                    yield from ((*here[:2], *part) for part in cutter.rest(here[5]))
            if where != here:
                here, cutter = where, _Cutter(*where[2:5])
            held = piece.decode("utf-8", "replace")
        if cutter is not None:
            yield from ((*here[:2], *part) for part in cutter.feed(held, not here[5] or here[6]))
            yield from ((*here[:2], *part) for part in cutter.rest(here[5]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in found(batches):
            out.append(row)
            size += len(row[3]) + 64
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return met.mapInArrow(run, "file string, split long, kind int, text string")


def _joined(parts: DataFrame) -> DataFrame:
    """The objects that cross borders of splits: a part or two per split, so few rows."""
    begun = (F.col("kind") == BEGUN).cast("int")
    # In a split the end of an object comes before the start of the next.
    order = Window.partitionBy("file").orderBy("split", begun)
    numbered = parts.withColumn("_number", F.sum(begun).over(order))
    gathered = F.array_sort(F.collect_list(F.struct("split", begun.alias("begun"), "text")))
    objects = numbered.groupBy("file", "_number").agg(gathered.alias("parts"))
    return objects.select("file", F.array_join(F.transform("parts", lambda part: part["text"]), "").alias("text"))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON files, each an array of objects or one object; a bad file gives no rows.

    Files of any size are read by as many tasks as they have splits. Bad is a file with an object that does not parse or
    does not fit the schema, with anything but commas between objects, or that ends too early. Empty files, files of
    white space and empty arrays have no rows. Compressed files cannot be split and are read by one task each.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    corrupt = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
    ship_package(spark)
    pieces = _pieces(spark, path)
    cut = materialize(_cut(pieces, _starts(materialize(_summaries(pieces)))))
    crossing = _joined(cut.filter(F.col("kind").isin(LATER, BEGUN)))
    objects = cut.filter(F.col("kind") == WHOLE).select("file", "text").unionByName(crossing)
    parsed = objects.select("file", F.from_json("text", corrupt, {"columnNameOfCorruptRecord": CORRUPT}).alias("row"))
    marks = cut.filter(F.col("kind").isin(BRACKET, FAULT)).select("file", _ones("objects", False), _ones("brackets", F.col("kind") == BRACKET), _ones("faults", F.col("kind") == FAULT))
    facts = parsed.select("file", _ones("objects", True), _ones("brackets", False), _ones("faults", F.col("row")[CORRUPT].isNotNull()))
    sums = marks.unionByName(facts).groupBy("file").agg(*[F.sum(name).alias(name) for name in ("objects", "brackets", "faults")])
    # An array has two brackets; without any there is one object.
    sound = (F.col("faults") == 0) & ((F.col("brackets") == 2) | ((F.col("brackets") == 0) & (F.col("objects") <= 1)))
    return parsed.join(sums.filter(~sound).select("file"), "file", "left_anti").select(*[F.col("row")[f.name].alias(f.name) for f in wanted.fields])


def _ones(name: str, here: Column | bool) -> Column:
    return (here if isinstance(here, Column) else F.lit(here)).cast("long").alias(name)


def write_arrays(df: DataFrame, folder: str, key: str, keys_per_file: int) -> None:
    """One JSON array a file, of the rows whose whole-number ``key`` lies in the same run of ``keys_per_file`` values.

    Files have bounded size if the key rarely repeats; a null key has a file of its own.
    """
    run = F.floor(F.col(key) / keys_per_file).alias("_run")
    arrays = df.groupBy(run).agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
