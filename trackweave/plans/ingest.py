"""Landed records to the unified raw table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.dates import parse_date
from trackweave.operators.enrichment import merge_sources, worth_a_lookup
from trackweave.operators.ranking import keep_first, union_sources


def collect_tracks(
    sources: Sequence[DataFrame], order: str, total: int | None, key: str = "track_id"
) -> DataFrame:
    """Equal quota of ``total`` from every result list, all rows without one; then the first occurrence of each id."""
    merged = union_sources(sources, None if total is None else total // len(sources), order)
    return keep_first(merged, [key], [F.col("source_order"), F.col("position")])


def by_genre(landed: DataFrame, genre: str, order: str, limit: int | None = 50) -> DataFrame:
    """The first ``limit`` tracks of a genre, all of them without one."""
    hits = landed.filter(F.col("genre") == genre)
    return hits if limit is None else hits.orderBy(order).limit(limit)


def new_releases(landed: DataFrame, as_of_year: int, order: str, limit: int | None = 50) -> DataFrame:
    released = parse_date(F.col("release_date").cast("string"))
    hits = landed.filter(F.year(released) == as_of_year)
    return hits if limit is None else hits.orderBy(order).limit(limit)


def build_unified(
    tracks: DataFrame,
    audio: DataFrame,
    lyrics: DataFrame,
    tags: DataFrame,
    lyrics_order: str | None = None,
    tags_order: str | None = None,
) -> DataFrame:
    """Tracks with audio columns and both enrichments; only rows with name and artist are looked up."""
    orders = {"lyrics_order": lyrics_order, "tags_order": tags_order}
    return merge_sources(tracks, lyrics, tags, audio, only=worth_a_lookup(), **orders)
