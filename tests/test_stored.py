"""Stored helpers: posting lists of grams, copies in order, the cache."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave.operators import lookup, text_index
from trackweave.sources import ordered, tables
from trackweave.sources.cache import TableCache
from trackweave.sources.ordered import ordered_copy


def name_rows():
    rng = random.Random(6)
    letters = "abcdé 😀"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
    rows = [(i, word(), word() if i % 4 else None, i % 3) for i in range(500)]
    rows += [(1000 + i, "The Same Name", None, 0) for i in range(250)]  # a third of the rows
    return [*rows, (2000, None, None, 1), (2001, "x", "y", 1), (2002, "ABCabc abcABC", "ÄÖ", 1)]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(name_rows(), "track_id int, track_name string, artist_name string, extra int").repartition(7)


@pytest.fixture(scope="module")
def index(names, tmp_path_factory):
    return text_index.build_text_index(names, str(tmp_path_factory.mktemp("index") / "grams"))


def brute_hits(text, limit, rows=None):
    holds = lambda value: value is not None and text.lower() in value.lower()
    return [r[0] for r in sorted(rows or name_rows(), key=lambda r: r[0]) if holds(r[1]) or holds(r[2])][:limit]


@pytest.mark.parametrize("text", ["ab", "é ", "abc", "same", "the same name", "abcd", "a b", "b c", "😀a", "äö", "zz", "zzz", "the same names", "name the", "C ABC"])
def test_index_finds_what_a_scan_finds(names, index, text):
    got = index.search(text, 7)
    assert [r.track_id for r in got.collect()] == brute_hits(text, 7) == [r.track_id for r in lookup.search(names, text, 7).collect()]
    assert got.columns == ["track_id", "track_name", "artist_name", "extra"]


def test_short_and_spaced_requests(names, index):
    ids = lambda df: [r.track_id for r in df.collect()]
    assert ids(lookup.autocomplete(names, " t", index=index)) == []
    assert ids(lookup.autocomplete(names, " Th ", index=index)) == brute_hits("th", 5)
    assert ids(lookup.search(names, "y", index=index)) == brute_hits("y", 10)  # one letter: a scan
    assert ids(lookup.search(names, "^x$", regex=True, index=index)) == [2001]
    with pytest.raises(ValueError):
        index.search("a", 5)


def test_many_candidates_are_joined(index, monkeypatch):
    monkeypatch.setattr(text_index, "PUSHED", 20)
    assert [r.track_id for r in index.search("the same", 9).collect()] == brute_hits("the same", 9)


def test_lists_are_pruned_by_their_statistics(spark, index):
    plan = index.candidates("abcd")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    assert index.candidates("same").count() == 250


def test_rows_can_be_added(spark, names, tmp_path):
    rows = name_rows()
    first = spark.createDataFrame(rows[:300], names.schema)
    grown = text_index.build_text_index(first, str(tmp_path / "grown"))
    grown.add(spark.createDataFrame(rows[300:], names.schema))
    for text in ("ab", "same", "abcd"):
        assert [r.track_id for r in grown.search(text, 6).collect()] == brute_hits(text, 6)
    empty = text_index.build_text_index(first.limit(0), str(tmp_path / "empty"))
    assert empty.search("ab", 5).count() == 0 and empty.search("abcd", 5).count() == 0


# --- copies in order ------------------------------------------------------------------------------


def test_pages_of_an_ordered_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "FILE_ROWS", 100)
    ids = [f"a prefix of many characters {i:05d}" for i in range(1000)] + [None, "a", "é"]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, "v") for i in ids], "id string, v string").repartition(5)
    copy = ordered_copy(df, str(tmp_path / "copy"), "id")
    expected = sorted(ids, key=lambda i: (i is not None, (i or "").encode()))
    manifest = copy.manifest()
    assert sum(rows for _, rows in manifest) == 1003 and max(rows for _, rows in manifest) <= 100
    for offset in (0, 1, 95, 100, 517, 940, 1000, 1002, 1003, 5000):
        page = copy.page(offset, 100)
        assert [r.id for r in page.collect()] == expected[offset : offset + 100]
        assert len(page.inputFiles()) <= 3
    for arguments in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            copy.page(**arguments)
    assert ordered_copy(df.limit(0), str(tmp_path / "none"), "id").page(0).count() == 0


def test_copying_takes_two_scans_whatever_the_prefix(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        scans.add(1)
        yield from batches

    ids = spark.range(0, 2000, 1, 1).select(F.format_string("twenty characters shared %06d", "id").alias("id"))
    rows = ids.mapInArrow(counted, "id string")
    page = ordered_copy(rows, str(tmp_path / "copy"), "id").page(1500, 3).collect()
    assert [r.id[-6:] for r in page] == ["001500", "001501", "001502"]
    # Counting, ranges and rows; nothing per character.
    assert scans.value <= 3


# --- cache ----------------------------------------------------------------------------------------


def test_cache_reloads_changed_and_old_tables(spark, tmp_path):
    path, now = str(tmp_path / "t"), [0.0]
    tables.replace_table(spark.range(5).toDF("i"), path)
    cache = TableCache(spark, lifetime=10.0, clock=lambda: now[0])
    first = cache.get(path)
    assert first.count() == 5 and cache.get(path) is first
    tables.append_table(spark.range(3).toDF("i"), path)
    grown = cache.get(path)
    assert grown is not first and grown.count() == 8 and not first.is_cached
    now[0] = 9.0
    assert cache.get(path) is grown
    now[0] = 10.0
    assert cache.get(path) is not grown
    cache.clear()
    assert cache.get(path, read=lambda s, p: s.read.parquet(p).filter("i < 2")).count() == 4
    cache.drop("unknown")


def test_cache_of_a_named_table(spark):
    tables.create_database(spark, "kept")
    tables.append_table(spark.range(4).toDF("i"), "kept.t")
    cache = TableCache(spark)
    assert cache.get("kept.t").count() == 4
    tables.append_table(spark.range(2).toDF("i"), "kept.t")
    assert cache.get("kept.t").count() == 6
    cache.clear()
    spark.sql("DROP DATABASE kept CASCADE")
