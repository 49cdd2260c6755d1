"""Column functions over tag and similar-item arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.functions.numeric import DECIMAL

TOP_TAGS = 10
TOP_SIMILAR = 5
TAG_COLUMNS = 3


def shape_tags(tags: Column, limit: int = TOP_TAGS, with_url: bool = True) -> Column:
    """First ``limit`` tags as ``{name, weight[, url]}``; a missing or bad weight counts as 0."""

    def shape(tag: Column) -> Column:
        fields = [tag["name"].alias("name"), F.coalesce(tag["weight"].try_cast("int"), F.lit(0)).alias("weight")]
        return F.struct(*fields, tag["url"].alias("url")) if with_url else F.struct(*fields)

    return F.transform(F.slice(tags, 1, limit), shape)


def tag_names(tags: Column) -> Column:
    return F.transform(tags, lambda tag: tag["name"])


def shape_similar(similar: Column, limit: int = TOP_SIMILAR) -> Column:
    """First ``limit`` similar items as ``{name, artist, match_score}``."""
    return F.transform(
        F.slice(similar, 1, limit),
        lambda item: F.struct(
            item["name"].alias("name"),
            item["artist"].alias("artist"),
            F.coalesce(item["match"].try_cast("double"), F.lit(0.0)).alias("match_score"),
        ),
    )


def strong_tags(tags: Column, min_weight: float = 0.0, limit: int = TOP_TAGS) -> Column:
    """Tags of at least the given weight, at most ``limit`` of them."""
    return F.slice(F.filter(tags, lambda tag: tag["weight"] >= min_weight), 1, limit)


def clean_playcount(playcount: Column) -> Column:
    """Play count as a non-negative double; missing, non-numeric or without end counts as 0."""
    number = F.regexp_extract(playcount.cast("string"), DECIMAL, 0).try_cast("double")
    finite = F.when(number < F.lit(float("inf")), number)
    return F.greatest(F.coalesce(finite, F.lit(0.0)), F.lit(0.0))


def tag_features(df: DataFrame, source: str = "lastfm", prefix: str = "lastfm") -> dict[str, Column]:
    """Counters and top tags of an enrichment struct; a NULL struct gives zeros and NULL tags."""
    fields = {field.name: field.dataType for field in df.schema[source].dataType.fields}
    features: dict[str, Column] = {}
    if "playcount" in fields:
        features[f"{prefix}_playcount"] = clean_playcount(F.col(f"{source}.playcount"))
        features[f"{prefix}_playcount_log"] = F.log1p(features[f"{prefix}_playcount"])
    if "tags" in fields:
        tags = F.col(f"{source}.tags")
        features[f"{prefix}_num_tags"] = F.coalesce(F.size(tags), F.lit(0))
        named = isinstance(fields["tags"].elementType, T.StructType)
        for position in range(TAG_COLUMNS):
            tag = F.get(tags, F.lit(position))
            features[f"{prefix}_tag_{position + 1}"] = tag["name"] if named else tag
    if "similar_tracks" in fields:
        features[f"{prefix}_num_similar"] = F.coalesce(F.size(F.col(f"{source}.similar_tracks")), F.lit(0))
    return features
