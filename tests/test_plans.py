"""Whole stages: landing, unifying, cleaning, vectors, recommendations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.plans import embed, ingest, recommend, transform
from trackweave.sources import arrays, records, tables
from trackweave.streaming.landing import append_landed


def record(**changes):
    base = {
        "id": "t1", "name": "Song", "popularity": 40, "duration_ms": 200000, "explicit": False,
        "artists": [{"id": "a1", "name": "Ann"}, {"id": "a2", "name": "Bob"}],
        "album": {"id": "b1", "name": "Album", "release_date": "2020-01-05"},
        "external_urls": {"spotify": "u"}, "external_ids": {}, "track_number": 1, "disc_number": 1,
    }
    return json.dumps({**base, **changes})


def without(key):
    kept = json.loads(record())
    kept.pop(key)
    return json.dumps(kept)


def test_flatten_records(spark):
    raw = [
        record(), record(id=None, popularity=None), record(artists=[]), record(album={"id": "b", "name": "n"}),
        without("external_ids"), without("popularity"), "{broken", record(external_ids={"isrc": "X"}, preview_url="p"), None,
    ]
    df = records.flatten_records(spark.createDataFrame([(r,) for r in raw], "raw string"))
    rows = df.collect()
    assert [(r.track_id, r.artist, r.popularity, r.isrc, r.preview_url) for r in rows] == [
        ("t1", "Ann", 40, None, None), (None, "Ann", None, None, None), ("t1", "Ann", 40, "X", "p"),
    ]
    assert df.columns[:15] == [f.split()[0] for f in schemas.FLAT_TRACK.split(", ")]
    assert rows[0].source == "spotify" and rows[0].ingested_at is not None


def test_record_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    (tmp_path / "in" / "bad.json").write_text("[{")
    assert sorted(r.a for r in arrays.read_records(spark, folder, "a int").collect()) == [1, 2]
    listed = records.list_files(spark, folder, "*.json").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed) == ["bad.json", "good.json"]
    assert sum(r.length for r in listed) > 0


BAD_FILES = [
    '[{', '[{"a":1}', '[{"a":1},{"a":2]', '{"a":1', '[{"a":1},,{"a":2}]', '{"a":1},{"a":2}', '{"a":1}]', '[{"a":"x"}]',
    '[1,2]', '[{"a":1}] }', '}', '[{"a":1}, "a}"]', '[{"a":1}][{"a":1}]', '[{"a":{"b":1}]',
]
GOOD_FILES = {"": [], "  ": [], "[]": [], "[ ]\n": [], '{"a":1}\n': [1], '{"a":2}': [2], '[{"a":3}] ': [3], "[{}]": [None]}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_array_files_over_splits(spark, tmp_path, small_splits):
    """Strings full of braces, quotes and escapes, objects longer than a split, files of one line and of many."""
    draw = random.Random(5)
    marks = ["}", "{", '"', "\\", "[", ",", "a", "é", "\n", "汉", "]"]
    rows = [
        {"a": i, "s": "".join(draw.choices(marks, k=draw.randrange(60))), "o": {"x": [{"y": i}, {"y": 2}]}} for i in range(600)
    ]
    rows[50]["s"] = '}{"' * 4000
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "line.json").write_text(json.dumps(rows[:300], ensure_ascii=False))
    (folder / "lines.json").write_text(json.dumps(rows[300:], indent=2))
    for i, text in enumerate(BAD_FILES):
        (folder / f"bad{i}.json").write_text(text)
    read = arrays.read_records(spark, str(folder), "a long, s string, o struct<x: array<struct<y: int>>>")
    assert read.columns == ["a", "s", "o"]
    assert sorted((r.a, r.s, r.o.x[0].y) for r in read.collect()) == [(r["a"], r["s"], r["a"]) for r in rows]
    assert arrays._pieces(spark, str(folder / "line.json")).rdd.getNumPartitions() > 4
    # as many objects as the line-delimited form of the same rows
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    assert records.read_lines(spark, str(tmp_path / "lines.json"), read.schema).exceptAll(read).isEmpty()


def test_odd_array_files(spark, tmp_path):
    for i, text in enumerate([*GOOD_FILES, *BAD_FILES]):
        (tmp_path / f"{i}.json").write_text(text)
    found = [r.a for r in arrays.read_records(spark, str(tmp_path), "a long").collect()]
    assert sorted(found, key=str) == sorted(sum(GOOD_FILES.values(), []), key=str)


def test_write_arrays(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k == 3 else "v") for k in range(25)] + [(None, "n")], "k long, v string")
    arrays.write_arrays(df, str(tmp_path / "out"), "k", 10)
    assert records.list_files(spark, str(tmp_path / "out"), "*.txt").count() == 4
    assert arrays.read_records(spark, str(tmp_path / "out"), df.schema).exceptAll(df).isEmpty()
    assert arrays.read_records(spark, str(tmp_path / "out"), df.schema).count() == 26


def test_manifest(spark, tmp_path):
    """Rows of noted files are not counted again; files of other writers are; replacing starts anew."""
    path = str(tmp_path / "a b+c")
    df = spark.range(10).withColumn("v", F.lit(1))
    tables.append_table(df.repartition(3), path, noted=True)
    tables.append_table(df.repartition(2), path, noted=True)
    noted = spark.read.parquet(f"{path}/{tables.MANIFEST}")
    assert noted.count() == 5 and noted.agg(F.sum("rows")).first()[0] == 20
    assert tables._unnoted(spark, path).isEmpty() and tables.read_table(spark, path).count() == 20
    df.withColumn("loaded_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    assert tables._unnoted(spark, path).count() == 1
    info = tables.table_info(spark, path).first()
    assert (info["rows"], info.files) == (30, 6)
    tables.append_table(df.coalesce(1), path, noted=True)
    assert spark.read.parquet(f"{path}/{tables.MANIFEST}").agg(F.sum("rows")).first()[0] == 40
    tables.replace_table(df.limit(0), path)
    info = tables.table_info(spark, path).first()
    assert info["rows"] == 0 and info.columns == ["id", "v"]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    tables.append_table(df, path)
    tables.append_table(df.withColumns({"more": F.lit(3), "loaded_at": F.lit("2020-01-01").cast("timestamp")}), path)
    merged = tables.read_table(spark, path, merge_schema=True)
    assert merged.count() == 2 and set(merged.columns) == {"id", "v", "loaded_at", "more"}
    assert merged.filter("loaded_at = '2020-01-01'").count() == 1
    info = tables.table_info(spark, path).first()
    assert info["rows"] == 2 and info.size_bytes > 0 and info.files >= 2
    tables.replace_table(df, path)
    assert tables.read_table(spark, path).columns == ["id", "v"]
    assert tables.run_sql(spark, "SELECT sum(id) AS s FROM some_rows", {"some_rows": df}).first().s == 1


def test_named_tables(spark):
    tables.create_database(spark, "landing_test")
    tables.create_database(spark, "landing_test")
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    tables.replace_table(df, "landing_test.rows")
    tables.replace_table(df, "landing_test.rows")
    assert tables.read_table(spark, "landing_test.rows", ["v"]).collect() == [("a",)]
    spark.sql("DROP DATABASE landing_test CASCADE")


def test_streamed_landing_takes_each_file_once(spark, tmp_path):
    landed, target, state = (str(tmp_path / name) for name in ("landed", "target", "state"))
    (tmp_path / "landed").mkdir()
    for run in range(2):
        (tmp_path / "landed" / f"run{run}.json").write_text("\n".join([record(id=f"t{run}"), record(artists=[])]))
        append_landed(spark, landed, target, state).awaitTermination()
    append_landed(spark, landed, target, state).awaitTermination()
    assert sorted(r.track_id for r in spark.read.parquet(target).collect()) == ["t0", "t1"]


@pytest.fixture(scope="module")
def unified(spark, tmp_path_factory):
    raw = [
        record(id=f"t{i}", name=f"Song number {i}", popularity=i % 100, duration_ms=100000 + 1000 * i,
               artists=[{"id": f"a{i % 7}", "name": f"Artist {i % 7}"}],
               album={"id": "b", "name": f"Album {i % 3}", "release_date": f"{1990 + i % 30}-02-03"})
        for i in range(60)
    ]
    tracks = records.flatten_records(spark.createDataFrame([(r,) for r in raw], "raw string"))
    audio = spark.createDataFrame([("t1", 0.5, 120.0)], "track_id string, energy double, tempo double")
    lyrics = spark.createDataFrame([("t1", 9, "S", "A", "la", 2, "u", 5, None, None, True)], schemas.LYRICS)
    tags = spark.createDataFrame(
        [(f"t{i}", "S", "A", ["rock", f"mood{i % 4}"], [("rock", 5, "u")], [], 10 * i, 3, "l") for i in range(0, 60, 2)], schemas.TAGS
    )
    path = str(tmp_path_factory.mktemp("raw") / "tracks_unified")
    tables.append_table(ingest.build_unified(tracks, audio, lyrics, tags), path)
    return tables.read_table(spark, path)


def test_unified_table(unified):
    rows = {r.track_id: r for r in unified.collect()}
    assert len(rows) == 60
    assert rows["t1"].energy == 0.5 and rows["t1"].genius.has_lyrics and rows["t1"].lastfm is None
    assert rows["t2"].genius is None and rows["t2"].lastfm.tags == ["rock", "mood2"] and rows["t2"].tempo is None
    assert rows["t2"].data_sources.asDict() == {"spotify": True, "genius": False, "lastfm": True}


def test_whole_chain(spark, unified, tmp_path):
    done = transform.transform(unified, as_of_year=2024, outlier_fields=())
    features = done.features.collect()
    assert len(features) == 60
    first = next(r for r in features if r.track_id == "t4")
    assert (first.release_decade, first.music_era, first.lastfm_num_tags, first.lastfm_tag_2, first.lastfm_playcount) == ("1990s", "90s", 2, "mood0", 40.0)
    assert done.report.filter("check = 'overall'").first().passed

    vectors = embed.build_vectors(done.features)
    path = str(tmp_path / "vectors")
    tables.replace_table(vectors.vectors, path)
    row = spark.read.parquet(path).filter("track_id = 't4'").first()
    assert row.document == "Song number 4 | Artist 4 | Album 1 | Tags: rock, mood0"
    table = recommend.cached(tables.read_vectors(spark, path))
    assert (row.embedding_dimension, row.feature_dimension, row.combined_dimension) == (768, 14, 782)

    for kind in recommend.VECTOR_TYPES:
        got = recommend.recommend_one(table, track_id="t4", k=5, embedding_type=kind, min_similarity=-1.0).collect()
        assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        assert "t4" not in {r.track_id for r in got}
    by_name = recommend.recommend_one(table, track_name="song NUMBER 4", k=3).collect()
    by_typo = recommend.recommend_one(table, track_name="Song nmber 4", artist_name="Artist 4", k=3).collect()
    by_stale_id = recommend.recommend_one(table, track_id="gone", track_name="Song number 4", k=3).collect()
    assert by_name == by_typo == by_stale_id != []
    assert recommend.recommend_one(table, track_name="qqqqqqq").count() == 0

    queries = spark.createDataFrame([(1, "song number 17"), (2, "zzz")], "query_id int, query_text string")
    found = recommend.semantic_search(table, queries, vectors.text_model, k=3).collect()
    best = min((r for r in found if r.query_id == 1), key=lambda r: r["rank"])
    assert best.track_id == "t17" and all(r.query_id == 1 for r in found)

    wide = recommend.with_features(recommend.recommend_one(table, track_id="t4", k=2), done.features, ("popularity", "release_year"))
    assert wide.count() == 2 and wide.filter("popularity IS NULL").count() == 0
    table.unpersist()


def test_filters_run_after_the_cut(spark):
    rows = [("q", "q", "A", "x", [1.0, 0.0])] + [(f"s{i}", "s", "A", "x", [1.0, 0.01 * i]) for i in range(1, 4)] + [("o", "o", "B", "x", [0.5, 0.5])]
    table = spark.createDataFrame(rows, "track_id string, track_name string, artist_name string, album_name string, combined_embedding array<double>")
    same = dict(track_id="q", k=2, exclude_same_artist=True)
    assert recommend.recommend_one(table, **same).count() == 0
    assert [r.track_id for r in recommend.recommend_one(table, **same, refill=True).collect()] == ["o"]
    assert recommend.recommend_one(table, track_id="q", k=10, min_similarity=0.99).count() == 3


def test_requests_are_checked(spark):
    table = spark.createDataFrame([("a", [1.0])], "track_id string, combined_embedding array<double>")
    for bad in (dict(), dict(track_id="a", k=0), dict(track_id="a", k=51), dict(track_id="a", embedding_type="x")):
        with pytest.raises(ValueError):
            recommend.recommend_one(table, **bad)


def test_missing_columns_skip_their_features(spark):
    df = spark.createDataFrame([("a", "b")], "track_id string, track_name string")
    assert transform.build_features(df, 2024).columns == ["track_id", "track_name"]
    assert embed.combine(df).columns == df.columns
