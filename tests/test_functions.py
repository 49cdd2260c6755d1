"""Edge rows of the column functions."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from trackweave.functions import dates, numeric, tags, text, vectors


def test_lyrics_tail(values):
    given = ["love 23", "123", "see23Embed", "tumbed12", None, "  a 7  ", "", "x\n12"]
    assert values(text.trim_lyrics_tail, given) == ["love", "123", "see23Embed", "tu", "", "a", "", "x"]


def test_normalize_text(values):
    given = ["  A \t B ", "A & B Déjà", "ñ X", "ñ", "a" * 500, "a" * 501, None, "", " a b\x1c", 'It\'s "ok" - (yes)!?.,']
    expected = ["A B", "A  B Dj", " X", None, "a" * 500, None, None, None, "a b", 'It\'s "ok" - (yes)!?.,']
    assert values(text.normalize_text, given) == expected


def test_strip_knows_what_python_strips(values):
    given = [c + "x" + c for c in text.BLANKS]
    assert values(text.strip, given) == ["x"] * len(given)


def test_description(values):
    given = ['{"plain": "p"}', '{"other": 1}', "{no json", "words", None]
    assert values(text.describe, given) == ["p", "", "{no json", "words", None]


def test_document(spark):
    rows = [("a", None, "c", "x", None, "y"), (None,) * 6, ("", "b", None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, t1 string, t2 string, t3 string")
    built = text.build_document([F.col("a"), F.col("b"), F.col("c")], [F.col("t1"), F.col("t2"), F.col("t3")])
    assert [r[0] for r in df.select(built).collect()] == ["a | c | Tags: x, y", "", " | b"]


def test_expand_query(values):
    given = ["Triste", "popular", "rock alegre", "a b rock", "nada", " jazz  duro ", ""]
    expected = ["canciones con mood Triste", "música de género popular", "canciones con mood rock alegre", "a b rock", "nada", "música de género  jazz  duro ", ""]
    assert values(text.expand_query, given) == expected


@pytest.mark.parametrize(
    "raw, number",
    [("12 ", 12.0), ("1e3", 1000.0), ("x", None), ("true", None), ("nan", None), ("1d", None), ("0x10", None), (".5", 0.5), ("-3.", -3.0), ("", None), (None, None)],
)
def test_number_from_string(spark, raw, number):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(numeric.to_number(df, "v")).first()[0] == number


def test_number_from_other_types(spark):
    df = spark.createDataFrame([(True, float("nan"), 3)], "b boolean, d double, i int")
    assert tuple(df.select(*[numeric.to_number(df, c) for c in "bdi"]).first()) == (1.0, None, 3.0)


def test_ranges(values):
    assert values(lambda c: numeric.in_range(c, 0, 100), [0.0, 100.0, -1.0, 101.0, None], "double") == [0.0, 100.0, None, None, None]
    assert values(lambda c: numeric.in_range(c, 0, 3600000), [3600000.0, 3600001.0], "double") == [3600000.0, None]


def test_popularity_bins(values):
    given = [-1.0, 0.0, 20.0, 20.5, 60.0, 100.0, 101.0, None]
    bins = values(lambda c: numeric.popularity_features(c)["popularity_bin"], given, "double")
    assert bins == ["nan", "very_low", "very_low", "low", "medium", "very_high", "nan", "nan"]
    popular = values(lambda c: numeric.popularity_features(c)["is_popular"], given, "double")
    assert popular == [0, 0, 0, 0, 1, 1, 1, 0]
    assert values(lambda c: numeric.popularity_features(c, None)["popularity_bin"], [None], "double") == [None]


def test_duration_bins(values):
    minutes = [0.0, 2.0, 3.0, 3.5, 5.0, 10.0, 11.0]
    feature = lambda name: values(lambda c: numeric.duration_features(c * 60000)[name], minutes, "double")
    assert feature("duration_category") == ["nan", "very_short", "short", "short", "medium", "long", "very_long"]
    assert feature("is_short_track") == [1, 1, 0, 0, 0, 0, 0]
    assert feature("is_long_track") == [0, 0, 0, 0, 0, 1, 1]


def test_percentage(values):
    assert values(numeric.percentage, [0.125, 0.124, 0.995], "double") == [13, 12, 100]


def test_dates(values, spark):
    given = ["2020-01-05", "1999", "1999-07", "bad", None]
    assert values(dates.parse_date, given) == [datetime.date(2020, 1, 5), None, None, None, None]
    wider = values(lambda c: dates.parse_date(c, ("yyyy-MM-dd", "yyyy-MM", "yyyy")), given)
    assert wider == [datetime.date(2020, 1, 5), datetime.date(1999, 1, 1), datetime.date(1999, 7, 1), None, None]
    df = spark.createDataFrame([(datetime.date(2025, 3, 4),), (None,), (datetime.date(1987, 1, 1),)], "d date")
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in dates.temporal_features(F.col("d"), 2024).items()]).collect()]
    assert rows == [
        (2025, 3, 4, "2020s", "2020s", -1, 1),
        (None, None, None, None, None, None, 0),
        (1987, 1, 1, "1980s", "older", 37, 0),
    ]


def test_eras(values):
    years = [1988, 1989, 1990, 1999, 2009, 2019, 2029, 2030, None]
    assert values(dates.era, years, "int") == ["older", "unknown", "90s", "unknown", "unknown", "unknown", "2020s", "unknown", None]


def test_tag_shapes(spark):
    rows = [
        ([("a", "5", "u"), ("b", None, "u"), ("c", "x", "u")], [("n", "m", "0.5"), ("o", "p", None)]),
        ([(str(i), "1", "u") for i in range(12)], [("n", "m", "1")] * 7),
    ]
    df = spark.createDataFrame(
        rows, "t array<struct<name:string,weight:string,url:string>>, s array<struct<name:string,artist:string,match:string>>"
    )
    shaped = df.select(tags.shape_tags(F.col("t")).alias("t"), tags.shape_similar(F.col("s")).alias("s")).collect()
    assert [tuple(x) for x in shaped[0].t] == [("a", 5, "u"), ("b", 0, "u"), ("c", 0, "u")]
    assert [tuple(x) for x in shaped[0].s] == [("n", "m", 0.5), ("o", "p", 0.0)]
    assert (len(shaped[1].t), len(shaped[1].s)) == (10, 5)


def test_tag_features(spark):
    df = spark.createDataFrame(
        [(None,), ((7, ["x"], []),), ((-3, ["a", "b", "c", "d"], ["s"]),)],
        "lastfm struct<playcount:long,tags:array<string>,similar_tracks:array<string>>",
    )
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in tags.tag_features(df).items()]).collect()]
    assert rows[0] == (0.0, 0.0, 0, None, None, None, 0)
    assert rows[1] == (7.0, pytest.approx(math.log(8)), 1, "x", None, None, 0)
    assert rows[2] == (0.0, 0.0, 4, "a", "b", "c", 1)


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    pick = lambda m: [r[0] for r in df.select(vectors.similarity(F.col("a"), F.col("b"), m)).collect()]
    assert pick("cosine") == [pytest.approx(0.8), 0.0]
    assert pick("dot") == [4.0, 0.0]
    assert pick("euclidean")[0] == pytest.approx(1 / (1 + math.sqrt(2)))
    with pytest.raises(ValueError):
        vectors.similarity(F.col("a"), F.col("b"), "manhattan")


def test_normalize_and_hybrid(spark):
    rows = [([3.0, 4.0], [1.0]), ([0.0, 0.0], [2.0]), ([0.0, 0.0], [0.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "t array<double>, f array<double>")
    out = df.select(vectors.l2_normalize(F.col("t")), vectors.hybrid_vector(F.col("t"), F.col("f"))).collect()
    assert [r[0] for r in out] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0], None]
    assert out[0][1] == pytest.approx([x / math.sqrt(0.58) for x in (0.42, 0.56, 0.3)])
    assert out[1][1] == [0.0, 0.0, 1.0]
    assert out[2][1] == [0.0, 0.0, 0.0]
    assert out[3][1] is None
    plain = df.select(vectors.hybrid_vector(F.col("t"), F.col("f"), normalize=False)).first()[0]
    assert plain == pytest.approx([2.1, 2.8, 0.3])


def test_hybrid_cosine_identity(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [0.5, 1.0, -1.0], [2.0, -1.0], [1.0, 1.0, 3.0])],
        "t array<double>, f array<double>, u array<double>, g array<double>",
    )
    whole = vectors.similarity(
        vectors.hybrid_vector(F.col("t"), F.col("f")), vectors.hybrid_vector(F.col("u"), F.col("g"))
    )
    parts = (0.49 * vectors.similarity(F.col("t"), F.col("u")) + 0.09 * vectors.similarity(F.col("f"), F.col("g"))) / 0.58
    left, right = df.select(whole, parts).first()
    assert left == pytest.approx(right)


@pytest.mark.parametrize("raw", ["12d", "Infinity", "-Infinity", "NaN", "0x1p3", "many", "-4", None])
def test_bad_playcounts_are_zero(values, raw):
    assert values(tags.clean_playcount, [raw]) == [0.0]


def test_good_playcounts(values):
    assert values(tags.clean_playcount, ["12", " 1e3 ", "7.5"]) == [12.0, 1000.0, 7.5]
    assert values(tags.clean_playcount, [12, 0], "long") == [12.0, 0.0]
