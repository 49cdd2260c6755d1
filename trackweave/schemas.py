"""Explicit schemas (DDL) at every table boundary and the fixed column lists."""

from __future__ import annotations

# Audio columns and their types.
AUDIO_FIELDS = {
    "danceability": "double",
    "energy": "double",
    "key": "int",
    "loudness": "double",
    "mode": "int",
    "speechiness": "double",
    "acousticness": "double",
    "instrumentalness": "double",
    "liveness": "double",
    "valence": "double",
    "tempo": "double",
    "time_signature": "int",
}

AUDIO = "track_id string, " + ", ".join(f"{name} {kind}" for name, kind in AUDIO_FIELDS.items())

LYRICS = (
    "track_id string, genius_id long, title string, artist string, lyrics string, lyrics_length int, "
    "url string, genius_popularity long, release_date string, description string, has_lyrics boolean"
)

TAG = "struct<name: string, weight: int, url: string>"
SIMILAR = "struct<name: string, artist: string, match_score: double>"

TAGS = (
    "track_id string, track_name string, artist_name string, tags array<string>, "
    f"tags_detailed array<{TAG}>, similar_tracks array<{SIMILAR}>, playcount long, listeners long, "
    "lastfm_url string"
)

FLAT_TRACK = (
    "track_id string, name string, artist string, artist_id string, album string, album_id string, "
    "release_date string, popularity long, duration_ms long, explicit boolean, preview_url string, "
    "spotify_url string, isrc string, track_number long, disc_number long"
)

# Column names that the downstream tables have.
RENAMED = {"name": "track_name", "artist": "artist_name", "album": "album_name"}
REQUIRED_FIELDS = ("track_id", "track_name", "artist_name")
TEXT_FIELDS = ("track_name", "artist_name", "album_name")
TAG_FIELDS = ("lastfm_tag_1", "lastfm_tag_2", "lastfm_tag_3")
NUMERIC_FEATURES = (
    "popularity",
    "duration_ms",
    "explicit",
    "lastfm_playcount",
    "popularity_normalized",
    "is_popular",
    "duration_seconds",
    "is_short_track",
    "is_long_track",
    "release_year",
    "track_age_years",
    "is_recent_release",
    "lastfm_num_tags",
    "lastfm_num_similar",
)
