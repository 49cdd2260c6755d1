"""Attaching optional records to a base table and counting how often that worked."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave import schemas
from trackweave.functions.tags import shape_similar, shape_tags, tag_names
from trackweave.functions.text import describe, trim_lyrics_tail
from trackweave.operators.ranking import keep_first
from trackweave.session import materialize

MIN_LYRICS = 50
AUDIO = "_audio"

# A key with ten thousand rows in a sample of one per cent is dealt to one task per so many rows.
HOT_SAMPLE = 0.01
HOT_SAMPLED_ROWS = 10_000
# On tables of more rows than a hundred billion a hot key is a larger one, so there are never more of them than this.
HOT_KEYS = 100_000


def worth_a_lookup(name: str = "name", artist: str = "artist") -> Column:
    """Neither name nor artist is missing or empty."""
    return (F.coalesce(F.col(name), F.lit("")) != "") & (F.coalesce(F.col(artist), F.lit("")) != "")


def lyrics_record(lyrics: Column, popularity: Column, description: Column) -> dict[str, Column]:
    """Cleaned lyrics with length and presence measured on the raw text."""
    length = F.coalesce(F.length(lyrics), F.lit(0))
    return {
        "lyrics": trim_lyrics_tail(lyrics),
        "lyrics_length": length,
        "genius_popularity": F.coalesce(popularity, F.lit(0)),
        "description": describe(description),
        "has_lyrics": length > MIN_LYRICS,
    }


def tags_record(tags: Column, similar: Column, playcount: Column, listeners: Column, limit: int = 10) -> dict[str, Column]:
    """Tag response: detailed tags, their names, similar items and counters."""
    detailed = shape_tags(tags, limit)
    return {
        "tags": tag_names(detailed),
        "tags_detailed": detailed,
        "similar_tracks": shape_similar(similar),
        "playcount": F.coalesce(playcount, F.lit(0)),
        "listeners": F.coalesce(listeners, F.lit(0)),
    }


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last one wins, as a keyed map filled in order would have it."""
    return keep_first(df, [key], [F.col(order).desc()])


@dataclass(frozen=True)
class Side:
    """An optional record to attach, packed into a struct of the given fields.

    Of several rows with one key the last by ``order`` counts; without an order, the largest record.
    """

    table: DataFrame
    name: str
    fields: Mapping[str, Column]
    only: Column | None = None  # condition on the base row
    order: str | None = None

    def per_key(self, key: str) -> DataFrame:
        """One row per key, combined before it is shuffled."""
        record = F.struct(*[column.alias(field) for field, column in self.fields.items()])
        rows = self.table.filter(F.col(key).isNotNull())
        if self.order is None:
            return rows.select(key, record.alias("_record")).groupBy(key).agg(F.max("_record").alias(self.name))
        rows = rows.select(key, F.struct(F.col(self.order).alias("_order"), record.alias("_record")).alias("_last"))
        last = rows.groupBy(key).agg(F.max("_last").alias("_last"))
        return last.select(key, F.col("_last._record").alias(self.name))


def hot_keys(base: DataFrame, key: str) -> DataFrame:
    """``key, _salts``: keys with so many rows in a sample that they would unbalance a join, NULL included, and over how
    many tasks each should go. All of them, at most ``HOT_KEYS``; a missed or a needless key changes the plan, never the result.
    """
    sampled = base.select(key).sample(fraction=HOT_SAMPLE, seed=1).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = max(HOT_SAMPLED_ROWS, math.ceil(base.count() * HOT_SAMPLE / HOT_KEYS))
    return sampled.filter(F.col("n") >= limit).select(key, (F.ceil(F.col("n") / limit) + 1).alias("_salts"))


def attach(base: DataFrame, sides: Sequence[Side], key: str) -> DataFrame:
    """Left joins on one key: a match becomes a struct, no match a NULL struct; the base's rows stay as many as they are.

    The base is stored, so it is computed once. Sides are broadcast only when Spark's own size check allows it; otherwise
    base and sides are shuffled once. Rows of a hot key would all meet in one task: they get a salt and go to many tasks,
    each with a copy of the key's one record per side.
    """
    base = materialize(base)
    packed = [(side, side.per_key(key)) for side in sides]
    # Bounded by HOT_KEYS.
    hot = materialize(hot_keys(base, key))
    rows, keys = base, [key]
    if hot.limit(1).count():
        hot = F.broadcast(hot.withColumnRenamed(key, "_hot_key"))
        rows = rows.join(hot, F.col(key).eqNullSafe(F.col("_hot_key")), "left")
        # Rows of a stored table have the same number at every run.
        rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))))
        rows, keys = rows.drop("_hot_key", "_salts"), [key, "_salt"]

        def replicated(table: DataFrame) -> DataFrame:
            copies = table.join(hot, F.col(key) == F.col("_hot_key"), "left")
            salts = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)
            return copies.withColumn("_salt", F.explode(salts)).drop("_hot_key", "_salts")

        packed = [(side, replicated(table)) for side, table in packed]
    for side, table in packed:
        rows = rows.join(table, keys, "left")
        if side.only is not None:
            rows = rows.withColumn(side.name, F.when(side.only, F.col(side.name)))
    return rows.select(*base.columns, *[side.name for side, _ in packed])


def merge_sources(
    base: DataFrame,
    lyrics: DataFrame,
    tags: DataFrame,
    audio: DataFrame | None = None,
    key: str = "track_id",
    only: Column | None = None,
    lyrics_order: str | None = None,
    tags_order: str | None = None,
) -> DataFrame:
    """Base rows with ``genius`` and ``lastfm`` structs, ``data_sources`` flags and ``merged_at``.

    ``only`` limits both enrichments to base rows that were worth a lookup; ``audio`` adds its
    columns in the same shuffle. Of repeated records of a key the last by its order column counts.
    """
    lyric_fields = {
        "genius_id": F.col("genius_id"),
        "lyrics": F.col("lyrics"),
        "lyrics_length": F.coalesce("lyrics_length", F.lit(0)),
        "description": F.col("description"),
        "genius_url": F.col("url"),
        "genius_popularity": F.coalesce("genius_popularity", F.lit(0)),
        "has_lyrics": F.coalesce("has_lyrics", F.lit(False)),
    }
    tag_fields = {
        "tags": _or_empty(tags, "tags"),
        "tags_detailed": _or_empty(tags, "tags_detailed"),
        "similar_tracks": _or_empty(tags, "similar_tracks"),
        "playcount": F.coalesce("playcount", F.lit(0)),
        "listeners": F.coalesce("listeners", F.lit(0)),
        "lastfm_url": F.col("lastfm_url"),
    }
    sides = [
        Side(lyrics, "genius", lyric_fields, only, lyrics_order),
        Side(tags, "lastfm", tag_fields, only, tags_order),
    ]
    if audio is not None:
        sides.append(_audio_side(audio))
    merged = _unpack_audio(attach(base, sides, key), base.columns)
    return merged.withColumn(
        "data_sources",
        F.struct(
            F.lit(True).alias("spotify"),
            F.col("genius").isNotNull().alias("genius"),
            F.col("lastfm").isNotNull().alias("lastfm"),
        ),
    ).withColumn("merged_at", F.current_timestamp())


def _or_empty(df: DataFrame, field: str) -> Column:
    empty = F.array().cast(T.ArrayType(df.schema[field].dataType.elementType))
    return F.coalesce(F.col(field), empty)


def _audio_side(audio: DataFrame) -> Side:
    return Side(audio, AUDIO, {name: F.col(name) for name in schemas.AUDIO_FIELDS if name in audio.columns})


def _unpack_audio(df: DataFrame, base_columns: Sequence[str]) -> DataFrame:
    """Audio fields as columns next to those of the base."""
    if AUDIO not in df.columns:
        return df
    others = [c for c in df.columns if c not in base_columns and c != AUDIO]
    return df.select(*base_columns, f"{AUDIO}.*", *others)


def attach_audio(base: DataFrame, audio: DataFrame, key: str = "track_id") -> DataFrame:
    """Optional audio columns by id, NULL where there is none."""
    return _unpack_audio(attach(base, [_audio_side(audio)], key), base.columns)


def hit_statistics(
    base: DataFrame, lyrics: DataFrame, tags: DataFrame, key: str = "track_id", only: Column | None = None
) -> DataFrame:
    """``merge_statistics`` of a merge that need not be made: only keys are read and joined."""
    asked = base.select(key, (F.lit(True) if only is None else only).alias("_asked"))
    for name, side in (("genius", lyrics), ("lastfm", tags)):
        keys = side.select(key).dropna().distinct().withColumn("_hit", F.lit(True))
        hit = F.when(F.col("_asked"), F.col("_hit")).alias(name)
        asked = asked.join(keys, key, "left").select(*asked.columns, hit)
    return merge_statistics(asked)


def merge_statistics(merged: DataFrame) -> DataFrame:
    """Totals and hit rates in per cent, as one row."""
    total = F.count(F.lit(1))
    with_lyrics = F.count("genius")
    with_tags = F.count("lastfm")
    complete = F.count_if(F.col("genius").isNotNull() & F.col("lastfm").isNotNull())

    def rate(part: Column) -> Column:
        return F.try_divide(part * F.lit(100.0), total)

    return merged.agg(
        total.alias("total"),
        with_lyrics.alias("with_lyrics"),
        with_tags.alias("with_tags"),
        complete.alias("complete"),
        rate(with_lyrics).alias("lyrics_rate"),
        rate(with_tags).alias("tags_rate"),
        rate(complete).alias("complete_rate"),
    )


def most_popular(base: DataFrame, limit: int = 5, order: str = "track_id") -> DataFrame:
    """The rows that the report shows. A merge keeps each base row, so they can be chosen before it."""
    return base.orderBy(F.col("popularity").desc_nulls_last(), order).limit(limit)


def verification_report(merged: DataFrame, limit: int = 5, order: str = "track_id") -> DataFrame:
    """Most popular rows with a lyrics mark and the number of tags."""
    return (
        merged.select(
            order,
            "name",
            "artist",
            "popularity",
            F.when(F.col("genius").isNotNull(), F.lit("Sí")).otherwise(F.lit("No")).alias("tiene_letras"),
            F.coalesce(F.size("lastfm.tags"), F.lit(0)).alias("num_tags"),
        )
        .orderBy(F.col("popularity").desc_nulls_last(), order)
        .limit(limit)
    )
