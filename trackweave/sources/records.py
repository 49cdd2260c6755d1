"""Landed JSON: nested catalogue records, line-delimited record files and the listing of files; arrays are in ``arrays``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = (
    "id string, name string, popularity long, duration_ms long, explicit boolean, preview_url string, "
    "artists array<struct<id: string, name: string>>, "
    "album struct<id: string, name: string, release_date: string>, "
    "external_urls struct<spotify: string>, external_ids struct<isrc: string>, "
    "track_number long, disc_number long"
)

# Output column -> path in the nested record, and whether the key must be present; a present but null
# value passes.
PATHS = {
    "track_id": ("$.id", True),
    "name": ("$.name", True),
    "artist": ("$.artists[0].name", True),
    "artist_id": ("$.artists[0].id", True),
    "album": ("$.album.name", True),
    "album_id": ("$.album.id", True),
    "release_date": ("$.album.release_date", True),
    "popularity": ("$.popularity", True),
    "duration_ms": ("$.duration_ms", True),
    "explicit": ("$.explicit", True),
    "preview_url": ("$.preview_url", False),
    "spotify_url": ("$.external_urls.spotify", True),
    "isrc": ("$.external_ids.isrc", False),
    "track_number": ("$.track_number", True),
    "disc_number": ("$.disc_number", True),
}
# An object that must exist although only an optional member is read from it.
REQUIRED_OBJECT = "$.external_ids"


def _value(record: Column, path: str) -> Column:
    for step in path.removeprefix("$.").split("."):
        name, first = step.removesuffix("[0]"), step.endswith("[0]")
        record = F.get(record[name], F.lit(0)) if first else record[name]
    return record


def flatten_records(df: DataFrame, raw: str = "raw", source: str = "spotify") -> DataFrame:
    """Flat rows from JSON strings. Bad JSON, a missing required key or no artist drops the record.

    One schema-based parse yields the values. It cannot tell a JSON null from an absent key, so a
    record with a NULL where a key is required is looked at once more as VARIANT, which can.
    """

    def flat(parsed: Column) -> Column:
        record, text = parsed["record"], parsed["text"]

        def present(path: str) -> Column:
            return F.try_variant_get(F.try_parse_json(text), path, "variant").isNotNull()

        complete = _value(record, REQUIRED_OBJECT).isNotNull() | present(REQUIRED_OBJECT)
        for path, needed in PATHS.values():
            if needed:
                complete = complete & (_value(record, path).isNotNull() | present(path))
        return F.struct(
            complete.alias("_complete"), *[_value(record, path).alias(name) for name, (path, _) in PATHS.items()]
        )

    parsed = F.struct(F.from_json(F.col(raw), RECORD).alias("record"), F.col(raw).alias("text"))
    # Zero or one struct per record; the lambda binds the parsed record, so it is parsed once.
    rows = F.filter(F.transform(F.array(parsed), flat), lambda row: row["_complete"])
    return (
        df.select(F.inline(rows))
        .drop("_complete")
        .withColumns({"ingested_at": F.current_timestamp(), "source": F.lit(source)})
    )


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of line-delimited JSON, the splittable form that large landings should use."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_pages(
    spark: SparkSession, path: str, schema: T.StructType | str, order: str | None = None, total: int | None = None
) -> DataFrame:
    """All page files of a folder as one result; with ``total`` only its first rows by ``order``."""
    rows = read_lines(spark, path, schema)
    if total is None:
        return rows
    if order is None:
        raise ValueError("a total needs an order")
    return rows.orderBy(order).limit(total)


def write_records(df: DataFrame, base: str, prefix: str, run_ts: str) -> str:
    """Add one run's records as JSON under ``base/prefix/run_ts=...``; returns the prefix path."""
    path = f"{base}/{prefix}"
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").json(path)
    return path


def list_files(spark: SparkSession, base: str, glob: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of the files below a folder; contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    )
    return listed.select("path", "length", "modificationTime")
