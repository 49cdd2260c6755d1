"""Tables: scan, append, replace, describe, query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.sources.records import list_files

VECTOR_COLUMNS = (
    "track_id",
    "track_name",
    "artist_name",
    "album_name",
    "text_embedding",
    "feature_embedding",
    "combined_embedding",
)

# Folder of a table in which its files are noted; scans pass over names that begin so.
MANIFEST = "_files"
NOTED = "file string, rows long, size long"
# Paths that a reader is given one by one.
MANY_FILES = 10_000


def read_table(
    spark: SparkSession, name: str, columns: Sequence[str] | None = None, merge_schema: bool = False
) -> DataFrame:
    """A catalogue table by name or a Parquet folder by path; ``columns`` prunes the scan.

    ``merge_schema`` unites the columns of all appended runs; it reads every file's footer.
    """
    is_path = "/" in name
    df = spark.read.option("mergeSchema", merge_schema).parquet(name) if is_path else spark.table(name)
    return df if columns is None else df.select(*columns)


def read_vectors(spark: SparkSession, name: str) -> DataFrame:
    """The seven columns the recommender needs."""
    return read_table(spark, name, VECTOR_COLUMNS)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row work on a scanned table that came in fewer splits than cores.

    Large tables come in more splits and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def append_table(df: DataFrame, name: str, noted: bool = False) -> None:
    """Append, stamping ``loaded_at`` in the rows that do not carry it; ``noted`` keeps the manifest, see ``note_files``."""
    now = F.current_timestamp()
    stamp = F.coalesce(F.col("loaded_at"), now) if "loaded_at" in df.columns else now
    _write(df.withColumn("loaded_at", stamp), name, "append", noted)


def replace_table(df: DataFrame, name: str, noted: bool = False) -> None:
    _write(df, name, "overwrite", noted)


def _write(df: DataFrame, name: str, mode: str, noted: bool) -> None:
    writer = df.write.mode(mode)
    writer.parquet(name) if "/" in name else writer.format("parquet").saveAsTable(name)
    if noted:
        note_files(df.sparkSession, name)


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def note_files(spark: SparkSession, name: str) -> None:
    """Add to a table's manifest the files that it lacks: path, rows, bytes. Only their footers are read.

    The manifest lies in a folder of the table that scans pass over, so replacing the table replaces it. Writers that do
    not keep it do no harm: the files they add are found by the listing.
    """
    folder = folder_of(spark, name)
    new = _counted(spark, folder, _unnoted(spark, folder))
    if new is not None:
        new.coalesce(1).write.mode("append").parquet(f"{folder}/{MANIFEST}")


def _noted(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(NOTED).parquet(f"{folder}/{MANIFEST}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, "*.parquet").withColumn("file", _plain(F.col("path")))


def _plain(path: Column) -> Column:
    """A path as listings write it, without scheme and escapes."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), F.lit("+"), F.lit("%2B")))


def _unnoted(spark: SparkSession, folder: str) -> DataFrame:
    listed, noted = _listed(spark, folder), _noted(spark, folder)
    return listed if noted is None else listed.join(noted, "file", "left_anti")


def _counted(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame | None:
    """``file, rows, size`` of ``files`` of a table, by their footers; None if there are none."""
    some = files.select("path", "file", "length").limit(MANY_FILES + 1).collect()
    if not some:
        return None
    # Beyond a bounded list of paths the footers of all files are read.
    few = len(some) <= MANY_FILES
    table = spark.read.parquet(*[row["path"] for row in some]) if few else spark.read.parquet(folder)
    lies = table.metadataColumn("_metadata")
    rows = table.groupBy(_plain(lies["file_path"]).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    if few:
        files = spark.createDataFrame([tuple(row) for row in some], "path string, file string, length long")
    # A file without rows is noted too, or it would be looked at again each time.
    sized = files.select("file", F.col("length").alias("size"))
    return sized.join(rows, "file", "left").select("file", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "size")


def table_info(spark: SparkSession, name: str) -> DataFrame:
    """``rows, size_bytes, files, columns, created, modified`` of a table by name or a Parquet folder by path, as one row.

    Files are listed; the rows of those in the manifest are known, only footers of others are read.
    """
    folder = folder_of(spark, name)
    listed, noted = _listed(spark, folder), _noted(spark, folder)
    table = read_table(spark, name)
    if noted is None:
        listed, others = listed.withColumn("rows", F.lit(0)), table.agg(F.count(F.lit(1))).scalar()
    else:
        listed = listed.join(noted.select("file", "rows"), "file", "left")
        unnoted = _counted(spark, folder, _unnoted(spark, folder))
        others = F.lit(0) if unnoted is None else unnoted.agg(F.sum("rows")).scalar()
    known = listed.agg(
        F.sum("rows").alias("known"),
        F.sum("length").alias("size_bytes"),
        F.count(F.lit(1)).alias("files"),
        F.min("modificationTime").alias("created"),
        F.max("modificationTime").alias("modified"),
    )
    return known.select(
        (F.coalesce("known", F.lit(0)) + F.coalesce(others, F.lit(0))).alias("rows"),
        "size_bytes",
        "files",
        F.array(*[F.lit(column) for column in table.columns]).alias("columns"),
        "created",
        "modified",
    )


def folder_of(spark: SparkSession, name: str) -> str:
    return name if "/" in name else location(spark, name)


def location(spark: SparkSession, name: str) -> str:
    """Folder of a catalogue table."""
    described = spark.sql(f"DESCRIBE FORMATTED {name}").filter(F.col("col_name") == "Location")
    return described.select("data_type").first()[0]


def run_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Ad-hoc SQL over tables and the given frames."""
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql)
