"""Finding catalogue rows by id, by name and by part of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.ranking import top_n
from trackweave.operators.text_index import TextIndex


def find_by_id(catalogue: DataFrame, track_id, key: str = "track_id") -> DataFrame:
    """All rows with the id; the equality reaches the Parquet scan."""
    return catalogue.filter(F.col(key) == F.lit(track_id))


def _same_text(column: str, text: str) -> Column:
    return F.lower(F.col(column)) == F.lower(F.lit(text))


def _holds(column: str, text: str, regex: bool) -> Column:
    # str.lower of the whole pattern is what the search means, escapes included.
    value = F.lower(F.col(column))
    hit = value.rlike(text.lower()) if regex else value.contains(text.lower())
    return F.coalesce(hit, F.lit(False))


def search(
    catalogue: DataFrame,
    query: str,
    limit: int = 10,
    regex: bool = False,
    name: str = "track_name",
    artist: str = "artist_name",
    order: str = "track_id",
    index: TextIndex | None = None,
) -> DataFrame:
    """Rows whose name or artist holds the text, ignoring case: the first ``limit`` in table order.

    An ``index`` of the catalogue serves plain texts of two letters or more.
    """
    if not query:
        raise ValueError("query must not be empty")
    if not 1 <= limit <= 50:
        raise ValueError("limit must lie between 1 and 50")
    if index is not None and not regex and len(query) >= 2:
        return index.search(query, limit).select(*catalogue.columns)
    hits = catalogue.filter(_holds(name, query, regex) | _holds(artist, query, regex))
    return top_n(hits, [F.col(order)], limit)


def autocomplete(
    catalogue: DataFrame,
    typed: str,
    pool: int | None = None,
    limit: int = 5,
    name: str = "track_name",
    artist: str = "artist_name",
    order: str = "track_id",
    index: TextIndex | None = None,
) -> DataFrame:
    """First hits in table order; nothing below two characters. ``pool`` looks at the first rows only.

    With an ``index`` of the catalogue a keystroke reads a few posting lists instead of all rows.
    """
    text = typed.strip()
    if len(text) < 2:
        return catalogue.limit(0)
    if index is not None and pool is None:
        return index.search(text, limit).select(*catalogue.columns)
    searched = catalogue if pool is None else top_n(catalogue, [F.col(order)], pool)
    hits = searched.filter(_holds(name, text, False) | _holds(artist, text, False))
    return top_n(hits, [F.col(order)], limit)


def resolve_exact(
    queries: DataFrame,
    catalogue: DataFrame,
    key: str = "track_id",
    name: str = "track_name",
    artist: str = "artist_name",
) -> DataFrame:
    """``query_id, track_id, track_name, artist_name, matched_id, method`` for many queries at once.

    A known id wins. Otherwise the name decides, ignoring case; the artist only matters when several
    rows share the name, and when it fits none of them the query stays open (``method`` NULL). The
    first row in id order stands for equals.

    The catalogue is cut to wanted ids and names, then reduced to one row per key with map-side
    combine, so the joins meet unique keys however often a name occurs.
    """
    asked = queries.select(
        "query_id",
        F.col(key).alias("_id"),
        F.lower(F.col(name)).alias("_name"),
        F.lower(F.col(artist)).alias("_artist"),
        *[F.col(c).alias(f"_asked_{c}") for c in (key, name, artist)],
    )
    rows = catalogue.select(
        F.col(key).alias("_item"),
        F.lower(F.col(name)).alias("_name"),
        F.coalesce(F.lower(F.col(artist)), F.lit("")).alias("_artist"),
    )
    wanted_ids = asked.select(F.col("_id").alias("_item")).dropna().distinct()
    wanted_names = asked.select("_name").dropna().distinct()
    by_id = rows.join(wanted_ids, "_item", "left_semi").select(F.col("_item").alias("_id")).distinct()
    named = rows.join(wanted_names, "_name", "left_semi")
    by_artist = named.groupBy("_name", "_artist").agg(F.count(F.lit(1)).alias("_rows"), F.min("_item").alias("_first"))
    by_name = by_artist.groupBy("_name").agg(F.sum("_rows").alias("_total"), F.min("_first").alias("_any"))
    # Reads every column of the aggregate, as the one above does, so both share one scan and shuffle.
    by_artist = by_artist.select("_name", "_artist", F.when(F.col("_rows") > 0, F.col("_first")).alias("_exact"))

    def spread_nulls(rows: DataFrame, column: str) -> DataFrame:
        """A missing key meets nothing, so it need not travel to where all the others are."""
        return rows.withColumn("_lane", F.when(F.col(column).isNull(), F.xxhash64("query_id")).otherwise(F.lit(0)))

    lane = F.lit(0).cast("long").alias("_lane")
    joined = spread_nulls(asked, "_id").join(by_id.select("_id", lane, F.lit(True).alias("_known")), ["_id", "_lane"], "left")
    joined = spread_nulls(joined, "_name").join(by_name.select("*", lane), ["_name", "_lane"], "left")
    joined = joined.join(by_artist.select("*", lane), ["_name", "_lane", "_artist"], "left")
    given_artist = F.coalesce(F.col("_artist"), F.lit("")) != ""
    named_hit = F.when((F.col("_total") > 1) & given_artist, F.col("_exact")).otherwise(F.col("_any"))
    return joined.select(
        "query_id",
        *[F.col(f"_asked_{c}").alias(c) for c in (key, name, artist)],
        F.when(F.col("_known"), F.col("_id")).otherwise(named_hit).alias("matched_id"),
        F.when(F.col("_known"), F.lit("id")).when(named_hit.isNotNull(), F.lit("name")).alias("method"),
    )
