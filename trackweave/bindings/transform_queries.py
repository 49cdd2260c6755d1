"""Cleaning, features, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.bindings.registry import query
from trackweave.bindings.stand_ins import CATALOGUE, DIRTY, catalogue, dirty_catalogue, select_sql, table, texts
from trackweave.functions.dates import parse_date, temporal_features
from trackweave.functions.numeric import duration_features, popularity_features
from trackweave.functions.tags import clean_playcount, strong_tags
from trackweave.functions.text import normalize_text, text_shape
from trackweave.operators import quality
from trackweave.operators.cleaning import Range, clean_text, fit_numeric_cleaner
from trackweave.operators.ranking import top_n_per_group
from trackweave.plans.transform import build_clean, build_features

# --- text ---------------------------------------------------------------------------------------

_NORMALIZED = r"""regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'),
                  '[^a-zA-Z0-9\s\-''".,!?()]', '', 'g')"""


@query(
    "clean_text",
    f"""
    SELECT doc_id, track_name, artist_name FROM (
        SELECT doc_id, CASE WHEN length(n) BETWEEN 1 AND 500 THEN n END AS track_name, source AS artist_name
        FROM (SELECT *, {_NORMALIZED} AS n FROM documents))
    WHERE track_name IS NOT NULL AND artist_name IS NOT NULL
    """,
)
def clean_documents(spark, folder):
    documents = texts(spark, folder).select(
        "doc_id", F.col("text").alias("track_name"), F.col("source").alias("artist_name")
    )
    return clean_text(documents)


@query(
    "text_counters",
    f"""
    SELECT count(*) AS records_processed, count(CASE WHEN length(n) BETWEEN 1 AND 500 THEN 1 END) AS records_modified,
           count(CASE WHEN length(n) BETWEEN 1 AND 500 THEN NULL ELSE 1 END) AS records_dropped
    FROM (SELECT {_NORMALIZED} AS n FROM documents)
    """,
)
def text_counters(spark, folder):
    documents = texts(spark, folder).select(F.col("text").alias("track_name"), F.col("source").alias("artist_name"))
    return quality.row_counters(documents, clean_text(documents))


@query(
    "normalize_whole_text",
    f"SELECT doc_id, CASE WHEN length(n) >= 1 THEN n END AS normalized FROM (SELECT doc_id, {_NORMALIZED} AS n FROM documents)",
)
def normalize_whole_text(spark, folder):
    longest = 2**31 - 1
    return texts(spark, folder).select(
        "doc_id", normalize_text(F.col("text"), 1, longest).alias("normalized")
    )


@query(
    "text_shape",
    r"""
    SELECT doc_id, CAST(len(words) AS INT) AS word_count, CAST(length(text) AS INT) AS char_count,
           round(CAST(length(array_to_string(words, '')) AS DOUBLE) / len(words), 6) AS avg_word_length
    FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents)
    """,
)
def shape_of_text(spark, folder):
    shape = text_shape(F.col("text"))
    shape["avg_word_length"] = F.round(shape["avg_word_length"], 6)
    return texts(spark, folder).select("doc_id", *[c.alias(name) for name, c in shape.items()])


# --- numbers ------------------------------------------------------------------------------------


def _ranged(field: str, upper: int) -> str:
    number = f"TRY_CAST({field} AS DOUBLE)"
    return f"CASE WHEN {number} BETWEEN 0 AND {upper} THEN {number} END"


_CHECKED = f"""
    raw AS ({select_sql(DIRTY)}),
    checked AS (SELECT track_id, {_ranged('popularity', 100)} AS popularity, {_ranged('duration_ms', 3600000)} AS duration_ms,
                       CASE WHEN explicit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS explicit,
                       greatest(coalesce(TRY_CAST(lastfm_playcount AS DOUBLE), 0.0), 0.0) AS lastfm_playcount FROM raw)
"""

_SURVIVORS = f"""
    {_CHECKED},
    p0 AS (SELECT * REPLACE (coalesce(popularity, (SELECT median(popularity) FROM checked)) AS popularity) FROM checked),
    p1 AS (SELECT * FROM p0 WHERE abs(popularity - (SELECT avg(popularity) FROM p0)) <= 3 * (SELECT stddev_samp(popularity) FROM p0)),
    d0 AS (SELECT * REPLACE (coalesce(duration_ms, (SELECT median(duration_ms) FROM p1)) AS duration_ms) FROM p1),
    d1 AS (SELECT * FROM d0 WHERE abs(duration_ms - (SELECT avg(duration_ms) FROM d0)) <= 3 * (SELECT stddev_samp(duration_ms) FROM d0)),
    e1 AS (SELECT * FROM d1 WHERE abs(explicit - (SELECT avg(explicit) FROM d1)) <= 3 * (SELECT stddev_samp(explicit) FROM d1))
"""


@query(
    "coerce_and_fill",
    f"""
    WITH {_CHECKED}
    SELECT track_id, coalesce(popularity, (SELECT median(popularity) FROM checked)) AS popularity,
           coalesce(duration_ms, (SELECT median(duration_ms) FROM checked)) AS duration_ms, explicit, lastfm_playcount
    FROM checked
    """,
)
def coerce_and_fill(spark, folder):
    raw = dirty_catalogue(spark, folder)
    cleaned = fit_numeric_cleaner(raw, outlier_fields=()).transform(raw)
    return cleaned.select(
        "track_id", "popularity", "duration_ms", "explicit",
        clean_playcount(F.col("lastfm_playcount")).alias("lastfm_playcount"),
    )


@query(
    "sequential_outliers",
    f"WITH {_SURVIVORS} SELECT track_id, popularity, duration_ms, explicit FROM e1",
)
def sequential_outliers(spark, folder):
    raw = dirty_catalogue(spark, folder)
    cleaned = fit_numeric_cleaner(raw).transform(raw)
    return cleaned.select("track_id", "popularity", "duration_ms", "explicit")


@query(
    "value_outliers",
    """
    SELECT event_id, value FROM events
    WHERE abs(value - (SELECT avg(value) FROM events)) <= 3 * (SELECT stddev_samp(value) FROM events)
    """,
)
def value_outliers(spark, folder):
    events = table(spark, folder, "events")
    cleaner = fit_numeric_cleaner(events, [Range("value", float("-inf"), float("inf"))])
    return cleaner.transform(events).select("event_id", "value")


@query(
    "cleaning_counters",
    f"""
    WITH {_SURVIVORS},
    nulls AS (SELECT track_id, TRY_CAST(popularity AS DOUBLE) IS NULL AS no_popularity, TRY_CAST(duration_ms AS DOUBLE) IS NULL AS no_duration FROM raw)
    SELECT (SELECT count(*) FROM raw) AS records_processed, (SELECT count(*) FROM e1) AS records_modified,
           (SELECT count(*) FROM nulls WHERE no_popularity)
             + (SELECT count(*) FROM nulls WHERE no_duration AND track_id IN (SELECT track_id FROM p1)) AS missing_filled,
           (SELECT count(*) FROM raw) - (SELECT count(*) FROM e1) AS outliers_removed
    """,
)
def cleaning_counters(spark, folder):
    raw = dirty_catalogue(spark, folder)
    return fit_numeric_cleaner(raw).metrics(raw)


@query(
    "retention",
    f"""
    WITH {_SURVIVORS}
    SELECT (SELECT count(*) FROM raw) AS rows_in, count(*) AS rows_out, (SELECT count(*) FROM raw) - count(*) AS rows_removed,
           round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM raw), 6) AS retention_rate, 15 AS new_columns FROM e1
    """,
)
def retention(spark, folder):
    raw = dirty_catalogue(spark, folder)
    clean, _ = build_clean(raw)
    summary = quality.retention(raw, clean, build_features(clean, as_of_year=2024))
    return summary.withColumn("retention_rate", F.round("retention_rate", 6))


# --- quality ------------------------------------------------------------------------------------

_WITH_COPIES = """
    SELECT * REPLACE (CASE WHEN track_id % 10 < 4 THEN NULL ELSE artist_name END AS artist_name) FROM cat
    UNION ALL SELECT * FROM cat WHERE popularity > 80
    UNION ALL SELECT * REPLACE (NULL AS track_id) FROM cat WHERE popularity > 90
"""


@query(
    "quality_report",
    f"""
    WITH cat AS ({select_sql(CATALOGUE)}), t AS ({_WITH_COPIES}),
    m AS (SELECT count(*) AS n, avg(CAST(track_id IS NOT NULL AS INT)) AS c_id, avg(CAST(track_name IS NOT NULL AS INT)) AS c_name,
                 avg(CAST(artist_name IS NOT NULL AS INT)) AS c_artist,
                 1 - (count(DISTINCT track_id) + max(CAST(track_id IS NULL AS INT))) / CAST(count(*) AS DOUBLE) AS dup,
                 avg(CAST(TRY_CAST(release_date AS DATE) IS NOT NULL AS INT)) AS dates FROM t),
    lines AS (
        SELECT 'required' AS "check", unnest(['track_id', 'track_name', 'artist_name']) AS field, 1.0::DOUBLE AS value, 1.0::DOUBLE AS threshold, true AS passed
        UNION ALL SELECT 'completeness', 'track_id', c_id, 0.7, c_id >= 0.7 FROM m
        UNION ALL SELECT 'completeness', 'track_name', c_name, 0.7, c_name >= 0.7 FROM m
        UNION ALL SELECT 'completeness', 'artist_name', c_artist, 0.7, c_artist >= 0.7 FROM m
        UNION ALL SELECT 'duplicates', 'track_id', dup, 0.05, dup <= 0.05 FROM m
        UNION ALL SELECT 'valid_dates', 'release_date', dates, 0.9, dates >= 0.9 FROM m)
    SELECT "check", field, round(value, 6) AS value, threshold, passed FROM lines
    UNION ALL SELECT 'overall', '*', CAST(bool_and(passed) AS INT), 1.0, bool_and(passed) FROM lines
    """,
)
def quality_of_catalogue(spark, folder):
    plain = catalogue(spark, folder)
    gaps = plain.withColumn("artist_name", F.when(F.col("track_id") % 10 >= 4, F.col("artist_name")))
    copies = plain.filter("popularity > 80")
    keyless = plain.filter("popularity > 90").withColumn("track_id", F.lit(None).cast("long"))
    rows = gaps.unionByName(copies).unionByName(keyless)
    return quality.quality_report(rows, date_field="release_date").withColumn("value", F.round("value", 6))


# --- features -----------------------------------------------------------------------------------

_BINS = """
    CASE WHEN {c} IS NULL OR NOT ({c} {first} {e[0]}) THEN 'nan' WHEN {c} <= {e[1]} THEN '{l[0]}' WHEN {c} <= {e[2]} THEN '{l[1]}'
         WHEN {c} <= {e[3]} THEN '{l[2]}' WHEN {c} <= {e[4]} THEN '{l[3]}' WHEN {c} <= {e[5]} THEN '{l[4]}' ELSE 'nan' END
"""
_POPULARITY_BIN = _BINS.format(
    c="popularity", first=">=", e=[0, 20, 40, 60, 80, 100], l=["very_low", "low", "medium", "high", "very_high"]
)
_DURATION_BIN = _BINS.format(
    c="(duration_ms / 60000.0)", first=">", e=[0, 2, 3.5, 5, 10, "CAST('inf' AS DOUBLE)"],
    l=["very_short", "short", "medium", "long", "very_long"],
)


@query(
    "numeric_features",
    f"""
    SELECT track_id, round(popularity / 100, 6) AS popularity_normalized, {_POPULARITY_BIN} AS popularity_bin,
           CAST(coalesce(popularity >= 60, false) AS INT) AS is_popular, round(duration_ms / 1000, 6) AS duration_seconds,
           round(duration_ms / 60000, 6) AS duration_minutes, {_DURATION_BIN} AS duration_category,
           CAST(coalesce(duration_ms / 60000 < 3, false) AS INT) AS is_short_track,
           CAST(coalesce(duration_ms / 60000 > 5, false) AS INT) AS is_long_track
    FROM (SELECT track_id, TRY_CAST(popularity AS DOUBLE) AS popularity, TRY_CAST(duration_ms AS DOUBLE) AS duration_ms FROM ({select_sql(DIRTY)}))
    """,
)
def numeric_features(spark, folder):
    rows = dirty_catalogue(spark, folder).select(
        "track_id",
        F.col("popularity").try_cast("double").alias("popularity"),
        F.col("duration_ms").try_cast("double").alias("duration_ms"),
    )
    features = {**popularity_features(F.col("popularity")), **duration_features(F.col("duration_ms"))}
    rounded = ("popularity_normalized", "duration_seconds", "duration_minutes")
    return rows.select(
        "track_id", *[(F.round(c, 6) if name in rounded else c).alias(name) for name, c in features.items()]
    )


_TEMPORAL = """
    CAST(year(d) AS DOUBLE) AS release_year, CAST(month(d) AS DOUBLE) AS release_month, CAST(day(d) AS DOUBLE) AS release_day,
    CAST(year(d) - year(d) % 10 AS VARCHAR) || 's' AS release_decade,
    CASE WHEN d IS NULL THEN NULL WHEN year(d) >= 2020 AND year(d) < 2030 THEN '2020s' WHEN year(d) >= 2010 AND year(d) < 2019 THEN '2010s'
         WHEN year(d) >= 2000 AND year(d) < 2009 THEN '2000s' WHEN year(d) >= 1990 AND year(d) < 1999 THEN '90s'
         WHEN year(d) >= 0 AND year(d) < 1989 THEN 'older' ELSE 'unknown' END AS music_era,
    CAST(2024 - year(d) AS DOUBLE) AS track_age_years, CAST(coalesce(2024 - year(d) < 1, false) AS INT) AS is_recent_release
"""


def _dated(columns):
    """Nullable integers as doubles: without a type of their own in a data frame."""
    nullable = ("release_year", "release_month", "release_day", "track_age_years")
    return [(c.cast("double") if name in nullable else c).alias(name) for name, c in columns.items()]


@query(
    "temporal_features",
    f"""
    SELECT track_id, {_TEMPORAL} FROM (
        SELECT track_id, CASE WHEN track_id % 7 <> 0 AND track_id % 5 <> 0 THEN CAST(release_date AS DATE) END AS d
        FROM ({select_sql(CATALOGUE)}))
    """,
)
def temporal(spark, folder):
    written = F.when(F.col("track_id") % 7 == 0, F.substring("release_date", 1, 7)).when(
        F.col("track_id") % 5 == 0, F.lit("soon")
    )
    rows = catalogue(spark, folder).withColumn("release_date", written.otherwise(F.col("release_date")))
    parsed = rows.select("track_id", parse_date(F.col("release_date")).alias("d"))
    return parsed.select("track_id", *_dated(temporal_features(F.col("d"), 2024)))


@query(
    "order_date_features",
    f"SELECT o_orderkey, {_TEMPORAL} FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
)
def order_date_features(spark, folder):
    dates = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return dates.select("o_orderkey", *_dated(temporal_features(F.col("d"), 2024)))


@query(
    "strong_tags",
    r"""
    WITH counted AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_partkey, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS tags
    FROM counted WHERE n >= 5 GROUP BY l_partkey
    """,
)
def tags_by_weight(spark, folder):
    """Return flags of a part as weighted tags, the ten strongest at most."""
    counted = table(spark, folder, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    counted = top_n_per_group(counted, ["l_partkey"], [F.col("n").desc(), F.col("l_returnflag")], 10)
    entry = F.struct(F.col("l_returnflag").alias("name"), F.col("n").alias("weight"))
    tags = counted.groupBy("l_partkey").agg(F.sort_array(F.collect_list(entry)).alias("tags"))
    named = tags.withColumn("tags", strong_tags(F.col("tags"), 5.0))
    text = F.transform("tags", lambda t: F.concat_ws(":", t["name"], t["weight"].cast("string")))
    return named.filter(F.size("tags") > 0).select("l_partkey", F.array_join(text, ",").alias("tags"))


@query(
    "clean_and_features",
    f"""
    WITH {_SURVIVORS},
    joined AS (SELECT e1.*, c.track_name, c.artist_name, c.album_name, CAST(c.release_date AS DATE) AS d
               FROM e1 JOIN ({select_sql(CATALOGUE)}) c USING (track_id))
    SELECT track_id, regexp_replace(track_name, '[^a-zA-Z0-9\\s\\-''".,!?()]', '', 'g') AS track_name,
           regexp_replace(artist_name, '[^a-zA-Z0-9\\s\\-''".,!?()]', '', 'g') AS artist_name,
           popularity, duration_ms, explicit, {_POPULARITY_BIN} AS popularity_bin, {_DURATION_BIN} AS duration_category, {_TEMPORAL}
    FROM joined
    """,
)
def clean_and_features(spark, folder):
    """The whole transformation stage over the dirty catalogue."""
    clean, _ = build_clean(dirty_catalogue(spark, folder))
    features = build_features(clean, as_of_year=2024)
    shown = (
        "track_name", "artist_name", "popularity", "duration_ms", "explicit", "popularity_bin", "duration_category",
        "release_year", "release_month", "release_day", "release_decade", "music_era", "track_age_years",
        "is_recent_release",
    )
    return features.select("track_id", *_dated({name: F.col(name) for name in shown}))
