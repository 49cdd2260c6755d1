"""Record flattening, shaping, enrichment, source union, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackweave.bindings.registry import query
from trackweave.bindings.stand_ins import CATALOGUE, catalogue, select_sql, table, texts
from trackweave.functions.tags import shape_tags, tag_features
from trackweave.operators import enrichment
from trackweave.operators.ranking import take_quota, keep_first, top_n_per_group
from trackweave.plans import ingest
from trackweave.session import shared_dir
from trackweave.sources import arrays, records, tables

# --- nested records -----------------------------------------------------------------------------


def _raw_records(spark, folder):
    """Parts as nested JSON strings; some without artists, some without an album, some not JSON."""
    key = F.col("p_partkey")
    artist = F.struct(F.col("p_brand").alias("name"), F.lower("p_brand").alias("id"))
    album = F.struct(
        F.col("p_type").alias("name"), F.lower("p_type").alias("id"), F.lit("1999-01-01").alias("release_date")
    )
    nested = F.to_json(
        F.struct(
            key.cast("string").alias("id"),
            F.col("p_name").alias("name"),
            (F.col("p_size") * 2).alias("popularity"),
            (F.col("p_size") * 15000).alias("duration_ms"),
            (key % 20 == 0).alias("explicit"),
            F.when(key % 11 == 0, F.array().cast("array<struct<name:string,id:string>>")).otherwise(F.array(artist)).alias("artists"),
            F.when(key % 13 != 0, album).alias("album"),
            F.struct(F.concat(F.lit("u/"), key.cast("string")).alias("spotify")).alias("external_urls"),
            F.when(key % 3 == 0, F.struct(F.lit("x").alias("isrc"))).otherwise(F.struct(F.lit(None).cast("string").alias("isrc"))).alias("external_ids"),
            F.lit(1).alias("track_number"),
            F.lit(1).alias("disc_number"),
        )
    )
    return table(spark, folder, "part").select(F.when(key % 97 == 5, F.lit("{broken")).otherwise(nested).alias("raw"))


@query(
    "flatten_records",
    """
    WITH audio AS (SELECT l_partkey, avg(l_discount) AS energy, avg(l_tax) AS valence FROM lineitem GROUP BY l_partkey)
    SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_name AS name, p_brand AS artist, lower(p_brand) AS artist_id,
           p_type AS album, '1999-01-01' AS release_date, CAST(p_size * 2 AS BIGINT) AS popularity,
           CAST(p_size * 15000 AS BIGINT) AS duration_ms, (p_partkey % 20 = 0) AS explicit,
           'u/' || p_partkey AS spotify_url, CASE WHEN p_partkey % 3 = 0 THEN 'x' END AS isrc,
           round(energy, 6) AS energy, round(valence, 6) AS valence
    FROM part LEFT JOIN audio ON l_partkey = p_partkey
    WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 97 <> 5
    """,
)
def flatten_records(spark, folder):
    flat = records.flatten_records(_raw_records(spark, folder))
    audio = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("track_id"))
        .agg(F.avg("l_discount").alias("energy"), F.avg("l_tax").alias("valence"))
    )
    return enrichment.attach_audio(flat, audio).select(
        "track_id", "name", "artist", "artist_id", "album", "release_date", "popularity", "duration_ms",
        "explicit", "spotify_url", "isrc", F.round("energy", 6).alias("energy"), F.round("valence", 6).alias("valence"),
    )


# --- tag and lyrics shaping ---------------------------------------------------------------------


@query(
    "shape_tags",
    """
    WITH counted AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    tags AS (SELECT user_id, count(*) AS num_tags, max(n) AS playcount,
                    string_agg(event_type, ',' ORDER BY event_type) AS tags,
                    string_agg(CAST(CASE WHEN n % 7 = 0 THEN 0 ELSE n END AS VARCHAR), ',' ORDER BY event_type) AS weights,
                    min(CASE WHEN place = 1 THEN event_type END) AS lastfm_tag_1,
                    min(CASE WHEN place = 2 THEN event_type END) AS lastfm_tag_2,
                    min(CASE WHEN place = 3 THEN event_type END) AS lastfm_tag_3
             FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS place FROM counted)
             WHERE place <= 10 GROUP BY user_id),
    best AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place
             FROM events),
    near AS (SELECT user_id, count(*) AS num_similar, round(sum(value), 6) AS match_total,
                       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS similar_names
                FROM best WHERE place <= 5 GROUP BY user_id)
    SELECT user_id, tags, weights, similar_names, match_total, CAST(playcount AS DOUBLE) AS lastfm_playcount,
           round(ln(1 + playcount), 6) AS lastfm_playcount_log, num_tags AS lastfm_num_tags,
           num_similar AS lastfm_num_similar, lastfm_tag_1, lastfm_tag_2, lastfm_tag_3
    FROM tags JOIN near USING (user_id)
    """,
)
def shape_tag_response(spark, folder):
    events = table(spark, folder, "events")
    counted = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # A bounded number of entries per user is chosen before anything is collected.
    tags = (
        top_n_per_group(counted, ["user_id"], [F.col("event_type")], 10)
        .groupBy("user_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("event_type").alias("name"),
                        F.when(F.col("n") % 7 != 0, F.col("n").cast("string")).alias("weight"),
                        F.lit("u").alias("url"),
                    )
                )
            ).alias("tags"),
            F.max("n").alias("playcount"),
        )
    )
    similar = (
        top_n_per_group(events, ["user_id"], [F.col("value").desc(), F.col("event_id")], 6)
        .groupBy("user_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "rank",
                        F.col("event_id").cast("string").alias("name"),
                        F.col("event_type").alias("artist"),
                        F.col("value").cast("string").alias("match"),
                    )
                )
            ).alias("similar")
        )
    )
    shaped = tags.join(similar, "user_id").select(
        "user_id",
        F.struct(
            *[
                column.alias(name)
                for name, column in enrichment.tags_record(
                    F.col("tags"), F.col("similar"), F.col("playcount"), F.lit(None).cast("long")
                ).items()
            ]
        ).alias("lastfm"),
        shape_tags(F.col("tags"), with_url=False).alias("artist_tags"),
    )
    return shaped.select(
        "user_id",
        F.array_join("lastfm.tags", ",").alias("tags"),
        F.array_join(F.transform("artist_tags", lambda t: t["weight"].cast("string")), ",").alias("weights"),
        F.array_join(F.transform("lastfm.similar_tracks", lambda s: s["name"]), ",").alias("similar_names"),
        F.round(
            F.aggregate("lastfm.similar_tracks", F.lit(0.0), lambda total, s: total + s["match_score"]), 6
        ).alias("match_total"),
        *[
            (F.round(column, 6) if name.endswith("_log") else column).alias(name)
            for name, column in tag_features(shaped).items()
        ],
    )


_LYRICS = "CASE WHEN doc_id % 3 = 0 THEN text || ' 23' WHEN doc_id % 3 = 1 THEN text || ' 23Embed' ELSE text END"


@query(
    "lyrics_records",
    rf"""
    WITH raw AS (SELECT doc_id, {_LYRICS} AS lyrics, n_chars,
                        CASE WHEN doc_id % 2 = 0 THEN '{{"plain": "' || lang || '"}}' ELSE source END AS description FROM documents),
    stripped AS (SELECT *, regexp_replace(lyrics, '^\s+|\s+$', '', 'g') AS s FROM raw),
    cut AS (SELECT *, CASE WHEN regexp_matches(s, '[0-9]$') AND NOT regexp_matches(s, '^[0-9Embed]+$')
                           THEN regexp_replace(s, '[0-9Embed]+$', '') ELSE s END AS c FROM stripped)
    SELECT doc_id, regexp_replace(c, '^\s+|\s+$', '', 'g') AS lyrics, CAST(length(lyrics) AS INT) AS lyrics_length,
           n_chars AS genius_popularity,
           CASE WHEN doc_id % 2 = 0 THEN json_extract_string(description, '$.plain') ELSE description END AS description,
           length(lyrics) > 50 AS has_lyrics
    FROM cut
    """,
)
def lyrics_records(spark, folder):
    described = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('{\"plain\": \"', lang, '\"}') ELSE source END")
    raw = texts(spark, folder).select(
        "doc_id", F.expr(_LYRICS).alias("raw"), "n_chars", described.alias("described")
    )
    shaped = enrichment.lyrics_record(F.col("raw"), F.col("n_chars"), F.col("described"))
    return raw.select("doc_id", *[column.alias(name) for name, column in shaped.items()])


# --- enrichment ---------------------------------------------------------------------------------


def _sources(spark, folder):
    """Base, audio, lyrics and tags; some lyrics and tags landed twice, and the last one counts."""
    documents = table(spark, folder, "documents")
    base = documents.select(
        F.col("doc_id").alias("track_id"),
        F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("name"),
        F.col("source").alias("artist"),
        F.col("n_chars").alias("popularity"),
    )
    audio = table(spark, folder, "events").groupBy(F.col("event_id").alias("track_id")).agg(F.max("value").alias("tempo"))
    lyrics = table(spark, folder, "labels").select(
        F.col("doc_id").alias("track_id"),
        F.col("doc_id").alias("genius_id"),
        F.lit(None).cast("string").alias("lyrics"),
        F.when(F.col("toxic") == 0, F.col("quality")).alias("lyrics_length"),
        F.lit(None).cast("string").alias("description"),
        F.lit("l").alias("url"),
        F.col("toxic").cast("long").alias("genius_popularity"),
        F.lit(None).cast("boolean").alias("has_lyrics"),
        F.lit(1).alias("landed"),
    )
    again = lyrics.filter("track_id % 5 = 0").withColumns({"lyrics_length": F.lit(7), "landed": F.lit(2)})
    lyrics = again.unionByName(lyrics)
    tags = table(spark, folder, "pages").select(
        F.col("page_id").alias("track_id"),
        F.split("url", "/").alias("tags"),
        F.lit(None).cast("array<struct<name:string,weight:int,url:string>>").alias("tags_detailed"),
        F.lit(None).cast("array<struct<name:string,artist:string,match_score:double>>").alias("similar_tracks"),
        F.length("html").cast("long").alias("playcount"),
        F.lit(None).cast("long").alias("listeners"),
        F.col("url").alias("lastfm_url"),
        F.lit(1).alias("landed"),
    )
    older = tags.filter("track_id % 4 = 0").withColumns({"playcount": F.lit(-1).cast("long"), "landed": F.lit(0)})
    tags = older.unionByName(tags)
    return base, audio, lyrics, tags


def _merged(spark, folder, chosen=lambda base: base):
    base, audio, lyrics, tags = _sources(spark, folder)
    return ingest.build_unified(chosen(base), audio, lyrics, tags, lyrics_order="landed", tags_order="landed")


_MERGED_SQL = """
    base AS (SELECT doc_id AS track_id, CASE WHEN doc_id % 10 <> 0 THEN lang END AS name, source AS artist, n_chars AS popularity
             FROM documents),
    asked AS (SELECT track_id FROM base WHERE coalesce(name, '') <> '' AND coalesce(artist, '') <> ''),
    lyrics AS (SELECT doc_id AS track_id, quality, toxic FROM labels WHERE doc_id IN (SELECT track_id FROM asked)),
    tags AS (SELECT page_id AS track_id, url, html FROM pages WHERE page_id IN (SELECT track_id FROM asked)),
    audio AS (SELECT event_id AS track_id, max(value) AS tempo FROM events GROUP BY event_id),
    merged AS (SELECT b.*, a.tempo, l.track_id AS lyrics_key, l.quality, l.toxic, t.track_id AS tags_key, t.url, t.html
               FROM base b LEFT JOIN audio a USING (track_id)
               LEFT JOIN lyrics l ON l.track_id = b.track_id LEFT JOIN tags t ON t.track_id = b.track_id)
"""


@query(
    "merge_sources",
    f"""
    WITH {_MERGED_SQL}
    SELECT track_id, name, artist, popularity, round(tempo, 6) AS tempo, lyrics_key IS NOT NULL AS has_genius, tags_key IS NOT NULL AS has_lastfm,
           CAST(CASE WHEN lyrics_key IS NOT NULL THEN CASE WHEN lyrics_key % 5 = 0 THEN 7 WHEN toxic = 0 THEN quality ELSE 0 END END AS DOUBLE) AS lyrics_length,
           CAST(CASE WHEN lyrics_key IS NOT NULL THEN toxic END AS DOUBLE) AS genius_popularity,
           CASE WHEN lyrics_key IS NOT NULL THEN 'false' END AS has_lyrics,
           CAST(CASE WHEN tags_key IS NOT NULL THEN length(html) END AS DOUBLE) AS playcount,
           CAST(CASE WHEN tags_key IS NOT NULL THEN 0 END AS DOUBLE) AS listeners,
           CAST(CASE WHEN tags_key IS NOT NULL THEN len(string_split(url, '/')) END AS DOUBLE) AS num_tags,
           CAST(CASE WHEN tags_key IS NOT NULL THEN 0 END AS DOUBLE) AS num_similar
    FROM merged
    """,
)
def merge_sources(spark, folder):
    return _merged(spark, folder).select(
        "track_id", "name", "artist", "popularity",
        F.round("tempo", 6).alias("tempo"),
        F.col("data_sources.genius").alias("has_genius"),
        F.col("data_sources.lastfm").alias("has_lastfm"),
        F.col("genius.lyrics_length").cast("double").alias("lyrics_length"),
        F.col("genius.genius_popularity").cast("double").alias("genius_popularity"),
        F.col("genius.has_lyrics").cast("string").alias("has_lyrics"),
        F.col("lastfm.playcount").cast("double").alias("playcount"),
        F.col("lastfm.listeners").cast("double").alias("listeners"),
        F.size("lastfm.tags").cast("double").alias("num_tags"),
        F.size("lastfm.similar_tracks").cast("double").alias("num_similar"),
    )


@query(
    "merge_statistics",
    f"""
    WITH {_MERGED_SQL},
    counted AS (SELECT count(*) AS total, count(lyrics_key) AS with_lyrics, count(tags_key) AS with_tags,
                       count(CASE WHEN lyrics_key IS NOT NULL AND tags_key IS NOT NULL THEN 1 END) AS complete FROM merged)
    SELECT *, round(with_lyrics * 100.0 / total, 6) AS lyrics_rate, round(with_tags * 100.0 / total, 6) AS tags_rate,
           round(complete * 100.0 / total, 6) AS complete_rate FROM counted
    """,
)
def merge_statistics(spark, folder):
    rates = ("lyrics_rate", "tags_rate", "complete_rate")
    base, _, lyrics, tags = _sources(spark, folder)
    found = enrichment.hit_statistics(base, lyrics, tags, only=enrichment.worth_a_lookup())
    return found.withColumns({name: F.round(name, 6) for name in rates})


@query(
    "verification_report",
    f"""
    WITH {_MERGED_SQL}
    SELECT track_id, name, artist, popularity, CASE WHEN lyrics_key IS NOT NULL THEN 'Sí' ELSE 'No' END AS tiene_letras,
           CASE WHEN tags_key IS NOT NULL THEN len(string_split(url, '/')) ELSE 0 END AS num_tags
    FROM merged ORDER BY popularity DESC, track_id LIMIT 5
    """,
)
def verification_report(spark, folder):
    return enrichment.verification_report(_merged(spark, folder, enrichment.most_popular))


# --- source union -------------------------------------------------------------------------------


@query(
    "union_quota_first",
    """
    WITH lists AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority,
                          row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS position FROM orders),
    taken AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, position) AS n
              FROM lists WHERE position <= 100)
    SELECT o_custkey AS track_id, o_orderkey, o_totalprice, o_orderpriority, position FROM taken WHERE n = 1
    """,
)
def union_quota_first(spark, folder):
    """Five result lists, one per priority, 100 rows from each, then one row per customer."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("track_id"), "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    lists = [orders.filter(F.col("o_orderpriority") == name) for name in priorities]
    return ingest.collect_tracks(lists, "o_orderkey", total=500).drop("source_order")


@query(
    "keep_first",
    """
    SELECT user_id, event_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1
    """,
)
def first_event(spark, folder):
    events = table(spark, folder, "events")
    return keep_first(events, ["user_id"], [F.col("ts"), F.col("event_id")]).select(
        "user_id", "event_id", "event_type", "value"
    )


@query(
    "source_quota",
    """
    SELECT event_type, event_id, value, position FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position FROM events) WHERE position <= 1500
    """,
)
def source_quota(spark, folder):
    """A quota beyond Catalyst's group limit: heaps per partition before the shuffle."""
    return take_quota(table(spark, folder, "events"), "event_type", 1500, "event_id").select(
        "event_type", "event_id", "value", "position"
    )


@query(
    "preset_genre",
    f"SELECT track_id, track_name, artist_name FROM ({select_sql(CATALOGUE)}) WHERE album_name = 'ECONOMY' ORDER BY track_id LIMIT 50",
)
def preset_genre(spark, folder):
    landed = catalogue(spark, folder).withColumn("genre", F.col("album_name"))
    return ingest.by_genre(landed, "ECONOMY", "track_id").select("track_id", "track_name", "artist_name")


@query(
    "preset_new_releases",
    f"""SELECT track_id, track_name, release_date FROM ({select_sql(CATALOGUE)})
        WHERE year(CAST(release_date AS DATE)) = 1986 ORDER BY track_id LIMIT 50""",
)
def preset_new_releases(spark, folder):
    return ingest.new_releases(catalogue(spark, folder), 1986, "track_id").select("track_id", "track_name", "release_date")


# --- sinks --------------------------------------------------------------------------------------


@query(
    "sink_round_trip",
    """
    SELECT 2 * count(*) AS rows, 2 AS runs, round(2 * sum(o_totalprice), 2) AS total,
           'o_orderkey,o_totalprice,o_orderpriority,run_ts,loaded_at' AS columns, 2 * count(*) AS stamped FROM orders
    """,
)
def sink_round_trip(spark, folder):
    """Orders written as record files by two runs, read back, appended twice over, described."""
    base = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    for run in ("run1", "run2"):
        landed = records.write_records(orders, base, "orders", run)
        rows = records.read_lines(spark, f"{landed}/run_ts={run}", orders.schema).withColumn("run_ts", F.lit(run))
        tables.append_table(rows, f"{base}/unified")
    unified = tables.read_table(spark, f"{base}/unified", merge_schema=True)
    tables.replace_table(unified, f"{base}/copy")
    copy = tables.read_table(spark, f"{base}/copy")
    info = tables.table_info(spark, f"{base}/copy").select(F.array_join("columns", ",").alias("columns")).scalar()
    return copy.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("run_ts").alias("runs"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        info.alias("columns"),
        F.count("loaded_at").alias("stamped"),
    )


@query(
    "ad_hoc_sql",
    """
    SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
)
def ad_hoc_sql(spark, folder):
    return tables.run_sql(
        spark,
        """SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
           FROM orders_view JOIN customer_view ON o_custkey = c_custkey GROUP BY c_mktsegment""",
        {"orders_view": table(spark, folder, "orders"), "customer_view": table(spark, folder, "customer")},
    )


# --- tables and files by name -------------------------------------------------------------------


@query(
    "record_files",
    """
    SELECT o_orderpriority AS priority, count(*) AS n_rows, round(sum(o_totalprice), 2) AS total,
           sum(hash_of) AS keys, (SELECT count(DISTINCT o_orderkey // 5000) FROM orders) AS n_files
    FROM (SELECT *, o_orderkey % 1009 AS hash_of FROM orders) GROUP BY o_orderpriority
    """,
)
def record_files(spark, folder):
    """Orders written as files of one JSON array each, listed, and read back."""
    base = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    arrays.write_arrays(orders, base, "o_orderkey", keys_per_file=5000)
    rows = arrays.read_records(spark, base, orders.schema)
    n_files = records.list_files(spark, base, "*.txt").agg(F.count(F.lit(1))).scalar()
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.sum(F.col("o_orderkey") % 1009).alias("keys"),
        F.first(n_files).alias("n_files"),
    )


@query(
    "table_by_name",
    """
    SELECT 2 * count(*) AS rows, true AS all_listed, 'o_orderkey,o_orderstatus,loaded_at' AS columns, 2 * count(*) AS read_back,
           2 * sum(o_orderkey) AS keys
    FROM orders
    """,
)
def table_by_name(spark, folder):
    """A database created, a table appended to twice by name, described by its manifest and read back by name."""
    database = f"landing_{uuid.uuid4().hex}"
    tables.create_database(spark, database)
    try:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
        for _ in range(2):
            tables.append_table(orders, f"{database}.orders", noted=True)
        info = tables.table_info(spark, f"{database}.orders").first()
        again = tables.read_table(spark, f"{database}.orders", ["o_orderkey"])
        lies = again.metadataColumn("_metadata")["file_path"]
        found = again.agg(F.count(F.lit(1)), F.sum("o_orderkey"), F.count_distinct(lies)).first()
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    row = [(info["rows"], info["files"] >= found[2], ",".join(info["columns"]), found[0], found[1])]
    return spark.createDataFrame(row, "rows long, all_listed boolean, columns string, read_back long, keys long")


@query(
    "vector_table_scan",
    """
    SELECT vec_id AS track_id, 'vector ' || vec_id AS track_name, 48 AS text_size, 16 AS feature_size, 64 AS combined_size FROM embeddings
    """,
)
def vector_table_scan(spark, folder):
    """The recommender's seven columns out of a wider stored table."""
    base = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    whole = F.col("embedding")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("track_id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("track_name"),
        F.col("label").cast("string").alias("artist_name"),
        F.lit("embeddings").alias("album_name"),
        F.slice(whole, 1, 48).alias("text_embedding"),
        F.slice(whole, 49, 16).alias("feature_embedding"),
        whole.alias("combined_embedding"),
        F.lit("not needed").alias("lyrics"),
    )
    tables.replace_table(rows, base)
    read = tables.read_vectors(spark, base)
    sizes = {"text_size": "text_embedding", "feature_size": "feature_embedding", "combined_size": "combined_embedding"}
    return read.select("track_id", "track_name", *[F.size(column).alias(name) for name, column in sizes.items()])
