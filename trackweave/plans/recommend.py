"""Recommendations for one item, for many, for a name, and for free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from trackweave.operators.blocks import small_table
from trackweave.operators.fuzzy import match_names
from trackweave.operators.lookup import find_by_id, resolve_exact
from trackweave.operators.neighbours import nearest
from trackweave.operators.ranking import keep_first, top_n_per_group
from trackweave.operators.text_vectors import HashedTextModel
from trackweave.operators.vector_index import VectorIndex
from trackweave.session import materialize

VECTOR_TYPES = ("text", "feature", "combined")
DISPLAY = ("track_name", "artist_name", "album_name")
PUSHED_IDS = 1000


def cached(catalogue: DataFrame) -> DataFrame:
    """Keep the catalogue for repeated queries; call ``unpersist`` on the result when done."""
    return catalogue.persist(StorageLevel.MEMORY_AND_DISK)


def check_request(k: int, embedding_type: str, track_id=None, track_name: str | None = None) -> None:
    if track_id is None and not track_name:
        raise ValueError("a track id or a track name is needed")
    if embedding_type not in VECTOR_TYPES:
        raise ValueError(f"embedding_type must be one of {VECTOR_TYPES}")
    if not 1 <= k <= 50:
        raise ValueError("k must lie between 1 and 50")


def request_problem(k: Column, embedding_type: Column, track_id: Column, track_name: Column) -> Column:
    """What is wrong with a request, NULL if nothing; for tables of requests, as ``check_request`` is for one."""
    nameless = track_id.isNull() & (F.coalesce(track_name, F.lit("")) == "")
    return (
        F.when(nameless, F.lit("a track id or a track name is needed"))
        .when(~F.coalesce(embedding_type.isin(*VECTOR_TYPES), F.lit(False)), F.lit("unknown embedding_type"))
        .when(~F.coalesce(k.between(1, 50), F.lit(False)), F.lit("k must lie between 1 and 50"))
    )


def resolve(queries: DataFrame, catalogue: DataFrame, fuzzy: bool = True, threshold: float = 0.8) -> DataFrame:
    """``query_id, matched_id, method`` by id, exact name or fuzzy name; unresolved queries drop out."""
    exact = resolve_exact(queries, catalogue)
    if fuzzy:
        # Both halves and the search read it.
        exact = materialize(exact)
    found = exact.filter(F.col("matched_id").isNotNull()).select("query_id", "matched_id", "method")
    if not fuzzy:
        return found
    rest = exact.filter(F.col("matched_id").isNull())
    close = match_names(rest, catalogue, threshold).select("query_id", "matched_id", F.lit("fuzzy").alias("method"))
    return found.unionByName(close)


def recommend(
    catalogue: DataFrame,
    targets: DataFrame,
    k: int = 10,
    embedding_type: str = "combined",
    metric: str = "cosine",
    exclude_same_artist: bool = False,
    min_similarity: float = 0.0,
    refill: bool = False,
    display: Sequence[str] = DISPLAY,
    index: VectorIndex | None = None,
) -> DataFrame:
    """k best rows per target. ``targets``: ``query_id, matched_id``; unknown ids give no rows.

    The filters run after the cut to k + 1, so fewer than k rows may remain; ``refill`` filters first. With an ``index``
    over the same vectors (its metric, the shown columns and the artist carried) the search is approximate.
    """
    if embedding_type not in VECTOR_TYPES:
        raise ValueError(f"embedding_type must be one of {VECTOR_TYPES}")
    vector = f"{embedding_type}_embedding"
    wanted = targets.select("query_id", F.col("matched_id").alias("track_id"))
    rows = catalogue.select("track_id", "artist_name", F.col(vector).alias("vector"))
    few = small_table(wanted.select("track_id"), PUSHED_IDS)
    if few is not None:
        # A short id list reaches the Parquet scan, so only its row groups are read for the queries.
        rows = rows.filter(F.col("track_id").isin(few.column(0).unique().to_pylist()))
    asked = keep_first(wanted.join(rows, "track_id"), ["query_id"], [F.col("track_id"), F.col("artist_name"), F.col("vector")])
    asked = asked.withColumnsRenamed({"track_id": "_own_id", "artist_name": "_own_artist"})
    excluded = [("_own_id", "track_id")]
    if exclude_same_artist and refill:
        excluded.append(("_own_artist", "artist_name"))
    shown = list(dict.fromkeys([*display, "artist_name"]))
    wanted_rows, options = k if refill else k + 1, {"carry": shown, "carry_query": ["_own_artist"], "exclude": excluded}
    if index is None:
        found = nearest(asked, catalogue.select("track_id", *shown, F.col(vector).alias("vector")), wanted_rows, metric, **options)
    else:
        found = index.nearest(asked, wanted_rows, **options)
    if exclude_same_artist and not refill:
        found = found.filter(~F.col("artist_name").eqNullSafe(F.col("_own_artist")))
    found = found.filter(F.col("score") >= min_similarity).drop("rank")
    ranked = top_n_per_group(found, ["query_id"], [F.col("score").desc(), F.col("track_id")], k)
    return _present(ranked, display)


def _present(ranked: DataFrame, display: Sequence[str]) -> DataFrame:
    return ranked.select("query_id", "rank", "track_id", *display, F.round("score", 4).alias("similarity_score"))


def recommend_one(
    catalogue: DataFrame,
    track_id=None,
    track_name: str | None = None,
    artist_name: str | None = None,
    k: int = 10,
    embedding_type: str = "combined",
    **options,
) -> DataFrame:
    """Recommendations for one item named by id, or by name and artist."""
    check_request(k, embedding_type, track_id, track_name)
    found = locate(catalogue, track_id, track_name, artist_name)
    id_type = catalogue.schema["track_id"].dataType.simpleString()
    targets = catalogue.sparkSession.createDataFrame(
        [] if found is None else [(0, found)], f"query_id int, matched_id {id_type}"
    )
    return recommend(catalogue, targets, k, embedding_type, **options)


def locate(catalogue: DataFrame, track_id=None, track_name: str | None = None, artist_name: str | None = None):
    """Id of one item by id, exact name or fuzzy name, whichever hits first; None without a hit."""
    if track_id is not None and find_by_id(catalogue, track_id).select("track_id").take(1):
        return track_id
    if not track_name:
        return None
    id_type = catalogue.schema["track_id"].dataType.simpleString()
    asked = catalogue.sparkSession.createDataFrame(
        [(0, None, track_name, artist_name)],
        f"query_id int, track_id {id_type}, track_name string, artist_name string",
    )
    hit = resolve(asked, catalogue, fuzzy=False).select("matched_id").take(1)
    hit = hit or match_names(asked, catalogue).select("matched_id").take(1)
    return hit[0][0] if hit else None


def recommend_batch(catalogue: DataFrame, track_ids: DataFrame, k: int = 10, embedding_type: str = "combined", **options) -> DataFrame:
    """Recommendations for every id in ``track_ids.track_id``."""
    targets = track_ids.select("track_id").distinct().select(F.col("track_id").alias("query_id"), F.col("track_id").alias("matched_id"))
    return recommend(catalogue, targets, k, embedding_type, **options)


def semantic_search(
    catalogue: DataFrame,
    queries: DataFrame,
    model: HashedTextModel,
    k: int = 10,
    min_similarity: float = 0.3,
    display: Sequence[str] = DISPLAY,
) -> DataFrame:
    """Catalogue rows whose text vector is closest to each query text; the score bound applies last."""
    asked = model.transform(queries.select("query_id", "query_text"), "query_text", "vector")
    items = catalogue.select("track_id", *display, F.col("text_embedding").alias("vector"))
    found = nearest(asked, items, k, carry=display).filter(F.col("score") >= min_similarity)
    return _present(found, display)


def with_features(results: DataFrame, features: DataFrame, columns: Sequence[str] = ("popularity", "release_year", "duration_minutes", "spotify_url")) -> DataFrame:
    """Wider response: extra catalogue columns for the few result rows."""
    extra = keep_first(features.select("track_id", *columns), ["track_id"], [F.col(c) for c in columns])
    return results.join(extra, "track_id", "left")
