"""Operators against brute force, hot keys and lost-precision cases included."""

import difflib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackweave.operators import (
    blocks,
    cleaning,
    enrichment,
    fuzzy,
    lookup,
    metric_blocks,
    neighbours,
    order_stats,
    quality,
    ranking,
    scaling,
    text_vectors,
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- exact quantiles ----------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["spread", "hot", "two", "negative"])
def test_quantiles_by_narrowing(spark, shape):
    rng = np.random.default_rng(3)
    data = {
        "spread": rng.normal(size=5000),
        "hot": np.where(rng.random(5000) < 0.4, 1.5, rng.random(5000) * 3),
        "two": np.where(rng.random(5000) < 0.5, 0.0, 1.0),
        "negative": np.concatenate([np.full(2500, -7.0), -rng.random(2501)]),
    }[shape]
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)] * 10, "x double").repartition(4)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = order_stats.quantiles(df, {"x": F.col("x")}, wanted, small=40, accuracy=50)["x"]
    assert found == pytest.approx(list(np.quantile(data, wanted)))
    direct = order_stats.quantiles(df, {"x": F.col("x")}, wanted)["x"]
    assert found == pytest.approx(direct)


def test_median_and_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (8.0, None), (None, None)], "a double, b double")
    assert order_stats.medians(df, {"a": F.col("a"), "b": F.col("b")}) == {"a": 3.0, "b": None}


def test_value_at_rank(spark):
    df = spark.range(0, 3000).withColumn("id", F.col("id") * 7)
    assert order_stats.value_at_rank(df, "id", 1234, small=30, accuracy=40) == 1234 * 7
    assert order_stats.value_at_rank(df, "id", 3000) is None


# --- ranking ------------------------------------------------------------------------------------


def test_group_limit_reaches_the_map_side(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    assert plan(ranking.keep_first(df, ["k"], [F.col("id")])).count("WindowGroupLimit") == 2


def test_top_n_with_hot_key_beyond_the_group_limit(spark):
    df = spark.range(0, 9000, 1, 6).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    found = ranking.top_n_per_group(df, ["k"], [F.col("id").desc()], 1200).toPandas()
    for key, group in df.toPandas().groupby("k"):
        expected = sorted(group["id"], reverse=True)[:1200]
        assert found[found.k == key].sort_values("rank")["id"].tolist() == expected


@pytest.mark.parametrize("kind", ["double", "string"])
def test_quotas_are_cut_before_the_shuffle(spark, kind):
    rng = random.Random(3)
    value = (lambda: rng.choice([None, float("nan"), -0.5, *[rng.random() for _ in range(20)]])) if kind == "double" else (lambda: rng.choice([None, "", "é", "Z", "a" * rng.randint(1, 9)]))
    rows = [(i, "hot" if i % 3 else rng.choice(["a", None]), value()) for i in range(9000)]
    df = spark.createDataFrame(rows, f"id int, source string, at {kind}").repartition(6)
    cut = ranking._first_per_partition(df, "source", "at", 100)
    assert cut.columns == df.columns and cut.count() <= 100 * 3 * 6
    got = ranking.take_quota(df, "source", 1100, "at").collect()

    def rank(v):
        if kind == "string":
            return (v is not None, (v or "").encode())
        missing = v is None or v != v
        return (v is not None, v is not None and v != v, 0.0 if missing else v)

    for source in ("hot", "a", None):
        expected = sorted(rank(v) for _, s, v in rows if s == source)[:1100]
        own = sorted((r.position, rank(r["at"])) for r in got if r.source == source)
        assert own == list(enumerate(expected, 1))


def test_union_keep_first_is_idempotent(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "track_id int, s string")
    two = spark.createDataFrame([(2, "b", 9), (4, "b", 9)], "track_id int, s string, extra int")
    merged = ranking.union_sources([one, two], 2, "track_id")
    first = ranking.keep_first(merged, ["track_id"], [F.col("source_order"), F.col("position")])
    assert sorted(map(tuple, first.select("track_id", "s", "extra").collect())) == [(1, "a", None), (2, "a", None), (4, "b", 9)]
    again = ranking.keep_first(first, ["track_id"], [F.col("source_order"), F.col("position")])
    assert sorted(again.collect()) == sorted(first.collect())


def test_pages(spark):
    df = spark.range(25_000)
    assert [r.id for r in ranking.page(df, "id", 20_000, 3).collect()] == [20_000, 20_001, 20_002]
    assert [r.id for r in ranking.page(df, "id", 3, 2).collect()] == [3, 4]
    assert ranking.page(df, "id", 30_000, 5).count() == 0
    assert ranking.with_total(df.limit(1), df).first()["total"] == 25_000
    with pytest.raises(ValueError):
        ranking.page(df, "id", 0, 101)


# --- cleaning -----------------------------------------------------------------------------------


def test_outliers(spark):
    flags = spark.createDataFrame([(float(i < 5),) for i in range(100)], "explicit double")
    assert cleaning.fit_numeric_cleaner(flags).transform(flags).count() == 95
    kept = cleaning.fit_numeric_cleaner(flags, outlier_fields=()).transform(flags)
    assert kept.count() == 100
    for rows in ([(3.0,)], [(0.1,)] * 49):
        same = spark.createDataFrame(rows, "popularity double").repartition(3)
        assert cleaning.fit_numeric_cleaner(same).transform(same).count() == len(rows)


def test_moments_of_the_filled_column(spark):
    rng = np.random.default_rng(5)
    raw = [None if rng.random() < 0.3 else float(x) for x in rng.gamma(2, 10, 800)]
    df = spark.createDataFrame([(x,) for x in raw], "popularity double")
    step = cleaning.fit_numeric_cleaner(df).steps[0]
    values = np.array([np.nan if x is None or x > 100 else x for x in raw])
    filled = np.where(np.isnan(values), np.nanmedian(values), values)
    assert step.fill == pytest.approx(np.nanmedian(values))
    assert step.keep_to == pytest.approx(filled.mean() + 3 * filled.std(ddof=1))
    assert step.keep_from == pytest.approx(filled.mean() - 3 * filled.std(ddof=1))


def test_all_missing_column_is_not_filled(spark):
    df = spark.createDataFrame([("x",), (None,)], "popularity string")
    cleaner = cleaning.fit_numeric_cleaner(df)
    assert [r[0] for r in cleaner.transform(df).collect()] == [None, None]
    assert cleaner.metrics(df).first().asDict() == {"records_processed": 2, "records_modified": 2, "missing_filled": 0, "outliers_removed": 0}


def test_range_nulls_do_not_count_as_filled(spark):
    df = spark.createDataFrame([("1",), (None,), ("-5",), ("2",)], "popularity string")
    assert cleaning.fit_numeric_cleaner(df).metrics(df).first()["missing_filled"] == 1


def test_clean_text_drops_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, " a ", "b", None), (2, "ñ", "b", "c"), (3, None, "b", "c")], "id int, track_name string, artist_name string, album_name string")
    assert list(map(tuple, cleaning.clean_text(df).collect())) == [(1, "a", "b", None)]


# --- quality ------------------------------------------------------------------------------------


def test_null_keys_are_duplicates_of_each_other(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), ("x", None), ("x", None)], "track_id string, track_name string")
    report = {(r.check, r.field): (r.value, r.passed) for r in quality.quality_report(df).collect()}
    assert report["duplicates", "track_id"] == (0.5, False)
    assert report["required", "artist_name"] == (0.0, False)
    assert report["completeness", "track_name"] == (0.5, False)
    assert ("completeness", "artist_name") not in report
    assert report["overall", "*"] == (0.0, False)


# --- scaling ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "kind, expected",
    [("standard", [-1.0690, -0.2673, 1.3363]), ("minmax", [0, 1 / 3, 1]), ("robust", [-2 / 3, 0, 4 / 3]), ("other", [-1.0690, -0.2673, 1.3363])],
)
def test_scalers(spark, kind, expected):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 5, None), (4.0, 5, None)], "x double, same int, none double")
    rows = scaling.feature_vectors(df, ["x", "same", "none", "absent"], kind).orderBy("x").collect()
    assert [r.feature_embedding[0] for r in rows] == pytest.approx(expected, abs=1e-4)
    assert {tuple(r.feature_embedding[1:]) for r in rows} == {(0.0, 0.0)}
    assert rows[0].feature_dimension == 3


def test_scaled_columns_are_standardised(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(None if rng.random() < 0.2 else float(x),) for x in rng.normal(50, 9, 500)], "x double")
    got = np.array([r.feature_embedding[0] for r in scaling.feature_vectors(df, ["x"]).collect()])
    assert (got.mean(), got.std()) == (pytest.approx(0, abs=1e-9), pytest.approx(1))
    assert scaling.feature_vectors(df, ["y"]).columns == ["x"]


def test_projection_matches_eigenvectors(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 4
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(data)], "id int, v array<double>")
    projection = scaling.fit_projection(df, "v", 3)
    spread, axes = np.linalg.eigh(np.cov(data.T))
    spread, axes = spread[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(6)])
    assert projection.explained_variance_ratio == pytest.approx(list(spread[:3] / spread.sum()))
    got = np.array([r.p for r in projection.transform(df, "v", "p").orderBy("id").collect()])
    assert got == pytest.approx((data - data.mean(axis=0)) @ axes[:, :3], abs=1e-8)


def test_pca_only_beyond_the_dimension(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(i % 3)) for i in range(30)], "a double, b double, c double")
    wide = scaling.feature_vectors(df, ["a", "b", "c"], dimension=2).first()
    assert (len(wide.feature_embedding), wide.feature_dimension) == (2, 2)
    assert scaling.feature_vectors(df, ["a", "b", "c"]).first().feature_dimension == 3


# --- text vectors -------------------------------------------------------------------------------


def test_hashed_text_is_unit_length_and_repeatable(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "three"), (3, ""), (4, None)], "id int, text string")
    model = text_vectors.fit_hashed_text(df, "text", 64)
    got = {r.id: r.text_embedding for r in model.transform(df, "text").collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and np.linalg.norm(got[2]) == pytest.approx(1)
    assert got[3] == [0.0] * 64 and got[4] is None
    again = {r.id: r.text_embedding for r in text_vectors.fit_hashed_text(df, "text", 64).transform(df, "text").collect()}
    assert again == got


def test_failed_batch_costs_only_itself(spark):
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("model down")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "t" * i) for i in range(8)], "id int, text string").coalesce(1)
    got = {r.id: r.text_embedding for r in text_vectors.embed_with(df, "text", embed, 1, batch_size=2).collect()}
    assert got == {0: [0.0], 1: [1.0], 2: None, 3: None, 4: [4.0], 5: [5.0], 6: [6.0], 7: [7.0]}


# --- neighbours ---------------------------------------------------------------------------------


def brute_force(queries, items, k, metric):
    def score(a, b):
        a, b = np.array(a), np.array(b)
        if metric == "dot":
            return a @ b
        if metric == "euclidean":
            return 1 / (1 + np.linalg.norm(a - b))
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b / size if size else 0.0

    found = []
    for q, a in queries:
        ranked = sorted(((-round(score(a, b), 9), i) for i, b in items if i != q and b is not None))[:k]
        found += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(ranked)]
    return found


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("path", ["broadcast", "cells", "balls"])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_neighbours_equal_brute_force(spark, metric, path, ids, monkeypatch):
    monkeypatch.setattr(neighbours, "MATRIX_ENTRIES", 900)
    monkeypatch.setattr(metric_blocks, "WORTH_PAIRS", 0 if path == "balls" else 1 << 60)
    rng = np.random.default_rng(7)
    base = rng.integers(-3, 4, size=(90, 4)).astype(float)
    base[30:60] = base[5]  # copies are a third of all rows
    base[61] = 0
    name = (lambda i: f"t{i:03d}") if ids == "string" else int
    items = [(name(i), [float(x) for x in row]) for i, row in enumerate(base)] + [(name(900), None)]
    df = spark.createDataFrame(items, f"track_id {ids}, vector array<double>").repartition(5)
    asked = df.filter(F.col("vector").isNotNull()).withColumnRenamed("track_id", "query_id")
    limits = dict(broadcast_rows=20, block_rows=25) if path != "broadcast" else {}
    got = neighbours.nearest(asked, df, 7, metric, exclude=[("query_id", "track_id")], **limits).collect()
    expected = brute_force(items[:-1], items, 7, metric)
    assert [(r.query_id, r["rank"], r.track_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [e[:3] for e in expected]
    assert {(r.query_id, r.track_id): r.score for r in got} == pytest.approx({(e[0], e[2]): e[3] for e in expected}, abs=1e-8)


def clusters(spark, n, dim=6, groups=30):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((groups, dim)) * 5
    points = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dim)) * 0.2
    points[: n // 3] = points[0]  # one vector holds a third of the rows
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(points)]
    return spark.createDataFrame(rows, "track_id long, vector array<double>").repartition(6)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_balls_skip_cells_and_lose_nothing(spark, metric, monkeypatch):
    df = clusters(spark, 3000)
    asked = df.withColumnRenamed("track_id", "query_id")
    told = []
    whole = metric_blocks.nearest_in_balls
    monkeypatch.setattr(metric_blocks, "nearest_in_balls", lambda *a: (told.append(whole(*a)), told[-1])[1])
    found = {}
    for worth in (0, 1 << 60):
        monkeypatch.setattr(metric_blocks, "WORTH_PAIRS", worth)
        rows = neighbours.nearest(asked, df, 5, metric, exclude=[("query_id", "track_id")], broadcast_rows=100, block_rows=100)
        found[worth] = sorted(tuple(r) for r in rows.collect())
    assert found[0] == found[1 << 60] and len(found[0]) == 15_000
    taken = told[0][1]
    # A third of the queries lies in a ball of a thousand equal rows, whose blocks they all need.
    assert taken["copies"] < (0.6 if metric != "dot" else 1.0) * taken["all"]


def test_balls_step_back_where_nothing_can_be_skipped(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((600, 60)))]
    df = spark.createDataFrame(rows, "track_id long, vector array<double>").repartition(4)
    asked = df.withColumnRenamed("track_id", "query_id")
    monkeypatch.setattr(metric_blocks, "WORTH_PAIRS", 0)
    monkeypatch.setattr(metric_blocks, "CENTRE_ROWS", 10)
    got = neighbours.nearest(asked, df, 3, broadcast_rows=50, block_rows=200).collect()
    monkeypatch.setattr(metric_blocks, "WORTH_PAIRS", 1 << 60)
    assert sorted(got) == sorted(neighbours.nearest(asked, df, 3, broadcast_rows=50, block_rows=200).collect())


def test_neighbour_arguments(spark):
    df = spark.createDataFrame([(1, [1.0])], "track_id int, vector array<double>")
    asked = df.withColumnRenamed("track_id", "query_id")
    for arguments in ({"k": 0}, {"k": 1, "metric": "x"}):
        with pytest.raises(ValueError):
            neighbours.nearest(asked, df, **arguments)
    assert neighbours.nearest(asked.limit(0), df, 3).count() == 0
    assert neighbours.nearest(asked, df.limit(0), 3).count() == 0
    assert neighbours.nearest(asked, df, 3, exclude=[("query_id", "track_id")]).count() == 0


def test_blocks_spread_one_hot_key(spark):
    df = spark.range(0, 40_000, 1, 16).withColumn("key", F.lit("same"))
    sizes = [r["count"] for r in df.groupBy(blocks.even_block(F.col("key"), 8)).count().collect()]
    assert max(sizes) < 40_000 * 0.5


def test_small_table_respects_its_bounds(spark):
    assert blocks.small_table(spark.range(10), 10).num_rows == 10
    assert blocks.small_table(spark.range(11), 10) is None
    assert blocks.small_table(spark.range(10), 10, max_bytes=8) is None


# --- lookup and fuzzy ---------------------------------------------------------------------------

CATALOGUE = [(1, "Blue Sky", "Ann"), (2, "blue sky", "Bob"), (3, "Lonely", "Cid"), (4, "Bluer Sky", "Ann"), (5, None, "Dan"), (6, "x(y", "Eve")]


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame([(*row, "al") for row in CATALOGUE], "track_id int, track_name string, artist_name string, album_name string")


def test_resolution_rules(spark, tracks):
    asked = spark.createDataFrame(
        [(1, 3, "blue sky", None), (2, 99, "BLUE SKY", "bob"), (3, None, "lonely", "nobody"), (4, None, "blue sky", "nobody"), (5, None, "zzz", None), (6, None, "Blue sky", "")],
        "query_id int, track_id int, track_name string, artist_name string",
    )
    got = {r.query_id: (r.matched_id, r.method) for r in lookup.resolve_exact(asked, tracks).collect()}
    assert got == {1: (3, "id"), 2: (2, "name"), 3: (3, "name"), 4: (None, None), 5: (None, None), 6: (1, "name")}


def test_search_and_autocomplete(tracks):
    assert [r.track_id for r in lookup.search(tracks, "BLUE").collect()] == [1, 2, 4]
    assert [r.track_id for r in lookup.search(tracks, "x(").collect()] == [6]
    assert [r.track_id for r in lookup.search(tracks, "^blu.*y$|dan", regex=True).collect()] == [1, 2, 4, 5]
    assert lookup.autocomplete(tracks, " b ").count() == 0
    assert [r.track_id for r in lookup.autocomplete(tracks, "sky", pool=2).collect()] == [1, 2]
    for bad in (dict(query=""), dict(query="a", limit=51)):
        with pytest.raises(ValueError):
            lookup.search(tracks, **bad)


def difflib_best(query, rows, threshold=0.8, autojunk=False):
    name, artist = query
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk).ratio()
    best = None
    for track_id, n, a in sorted(rows):
        score = ratio(name, n)
        if artist:
            score = score * 0.7 + ratio(artist, a) * 0.3
        if score >= threshold and (best is None or score > best[1]):
            best = (track_id, score)
    return best


@pytest.mark.parametrize("limits", [{}, dict(broadcast_rows=10, block_rows=16), dict(autojunk=True)])
def test_fuzzy_equals_difflib(spark, limits):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdE ") for _ in range(rng.randint(1, 9)))
    rows = [(i, word(), word()) for i in range(60)]
    rows += [(100 + i, rows[3][1], rows[3][2]) for i in range(30)]  # copies
    rows += [(200, "q" * 150 + "ab" * 60, "long")]
    queries = [(i, n[:-1] or n, a if i % 3 else None) for i, (_, n, a) in enumerate(rows[:40])] + [(77, "q" * 150 + "ba" * 60, None)]
    catalogue = spark.createDataFrame(rows, "track_id int, track_name string, artist_name string")
    asked = spark.createDataFrame(queries, "query_id int, track_name string, artist_name string")
    got = {r.query_id: (r.matched_id, r.score) for r in fuzzy.match_names(asked, catalogue, **limits).collect()}
    expected = {i: difflib_best((n, a), rows, autojunk=limits.get("autojunk", False)) for i, n, a in queries}
    assert got == {i: e for i, e in expected.items() if e}


@pytest.mark.parametrize("bits", [256, 64])
def test_fuzzy_compares_few_pairs_and_loses_none(monkeypatch, bits):
    monkeypatch.setattr(fuzzy, "MAX_BITS", bits)
    monkeypatch.setattr(fuzzy, "PAIRS", 5000)
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöü "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, word(rng.randint(4, 40)), word(rng.randint(3, 12))) for i in range(1500)]
    rows += [(2000 + i, rows[0][1], word(8)) for i in range(300)]  # one popular name
    changed = [name[:3] + "x" + name[4:] for _, name, _ in rows[:200]]
    asked = [(name, rows[i][2] if i % 2 else "") for i, name in enumerate(changed)]
    queries = pa.table({"asked_name": [n for n, _ in asked], "asked_artist": [a for _, a in asked]})
    columns = {"matched_id": [r[0] for r in rows], "_name": [r[1] for r in rows], "_artist": [r[2] for r in rows]}
    compared = []
    ratio = fuzzy._ratio
    monkeypatch.setattr(fuzzy, "_ratio", lambda *a: (compared.append(a), ratio(*a))[1])
    got = fuzzy._best(queries, [pa.table(columns).slice(0, 900), pa.table(columns).slice(900)], 0.8, False)
    found = {(r["asked_name"], r["asked_artist"]): (r["matched_id"], r["score"]) for r in got.to_pylist()}
    assert found == {q: best for q in asked if (best := difflib_best(q, rows))}
    assert len(compared) < 0.02 * len(asked) * len({r[1] for r in rows})


def test_fuzzy_meets_only_lengths_in_reach(spark):
    names = [(i, "n" * (1 + i), "") for i in range(400)]
    pairs = spark.createDataFrame(names, "matched_id int, _name string, _artist string")
    wanted = spark.createDataFrame([("n" * 100, ""), ("n" * 30, "a")], "asked_name string, asked_artist string")
    left, right = fuzzy._by_length(wanted, pairs, 0.8, 10)
    met = left.join(right, "_block").select(F.length("asked_name").alias("a"), F.length("_name").alias("b"))
    reached = {(r.a, r.b) for r in met.collect()}
    assert {b for a, b in reached if a == 100} >= set(range(67, 151)) and max(b for a, b in reached if a == 100) < 200
    assert {b for a, b in reached if a == 30} >= set(range(17, 54)) and max(b for a, b in reached if a == 30) < 80


def test_fuzzy_threshold_is_inclusive_and_ties_take_the_lowest_id(spark):
    catalogue = spark.createDataFrame([(9, "abcdX", "a"), (4, "abcdY", "a")], "track_id int, track_name string, artist_name string")
    asked = spark.createDataFrame([(1, "abcdZ", None)], "query_id int, track_name string, artist_name string")
    assert tuple(fuzzy.match_names(asked, catalogue).first()) == (1, 4, 0.8)


# --- enrichment ---------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_attach_keeps_rows_without_key(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(enrichment, "HOT_SAMPLE", 1.0)
        monkeypatch.setattr(enrichment, "HOT_SAMPLED_ROWS", 2)
    base = spark.createDataFrame([(1,), (None,), (None,), (2,), (3,), (3,), (3,)], "track_id int")
    side = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "track_id int, v string")
    assert {r.track_id for r in enrichment.hot_keys(base, "track_id").collect()} == ({3, None} if hot else set())
    sides = [
        enrichment.Side(side, "s", {"v": F.col("v")}),
        enrichment.Side(side, "t", {"w": F.upper("v")}, only=F.col("track_id") == 3),
    ]
    got = [(r.track_id, r.s and r.s.v, r.t and r.t.w) for r in enrichment.attach(base, sides, "track_id").collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "a", None), (2, None, None), (None, None, None), (None, None, None)] + [(3, "c", "C")] * 3, key=str
    )


def test_one_shuffle_of_the_base_for_all_sides(spark):
    base = spark.range(1000).withColumnRenamed("id", "track_id")
    sides = [enrichment.Side(base.withColumn("v", F.lit(n)), f"s{n}", {"v": F.col("v")}) for n in range(3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = plan(enrichment.attach(base, sides, "track_id")).count("Exchange hashpartitioning(track_id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles == 4


def test_five_hundred_hot_keys_and_one_evaluation_of_the_base(spark, monkeypatch):
    monkeypatch.setattr(enrichment, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(enrichment, "HOT_SAMPLED_ROWS", 10)
    rows = [(k, i) for k in range(500) for i in range(10 + k % 7)] + [(None, i) for i in range(400)] + [(9000 + i, i) for i in range(50)]
    rows += [(7, i) for i in range(3000)]  # the largest
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    base = spark.createDataFrame(rows, "track_id int, i int").repartition(6).mapInArrow(counted, "track_id int, i int")
    side = spark.createDataFrame([(k, f"v{k}") for k in range(0, 9100, 2)], "track_id int, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = enrichment.attach(base, [enrichment.Side(side, n, {"v": F.col("v")}) for n in ("s", "t")], "track_id")
        got = [(r.track_id, r.i, r.s and r.s.v, r.t and r.t.v) for r in merged.collect()]
        value = lambda k: f"v{k}" if k is not None and k % 2 == 0 and k < 9100 else None
        assert sorted(got, key=repr) == sorted([(k, i, value(k), value(k)) for k, i in rows], key=repr)
        assert seen.value == len(rows)
        # The largest key's rows lie in many partitions of the join.
        sizes = merged.filter("track_id = 7").groupBy(F.spark_partition_id()).count()
        assert sizes.count() > 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_last_per_key(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "track_id int, seq int, v string")
    assert sorted((r.track_id, r.v) for r in enrichment.last_per_key(df, "track_id", "seq").collect()) == [(1, "new"), (2, "x")]


def test_statistics_of_an_empty_merge(spark):
    df = spark.createDataFrame([], "genius struct<a:int>, lastfm struct<a:int>")
    row = enrichment.merge_statistics(df).first()
    assert (row.total, row.lyrics_rate) == (0, None)


def test_repeated_side_records_do_not_multiply_the_base(spark):
    base = spark.createDataFrame([(1, "n", "a"), (1, "m", "a"), (2, "o", "b")], "track_id int, name string, artist string")
    lyrics = spark.createDataFrame(
        [(1, 10, "old", 1), (1, 11, "new", 2), (None, 12, "none", 3)], "track_id int, genius_id int, lyrics string, landed int"
    )
    for column, kind in {"lyrics_length": "int", "description": "string", "url": "string", "genius_popularity": "long", "has_lyrics": "boolean"}.items():
        lyrics = lyrics.withColumn(column, F.lit(None).cast(kind))
    tags = spark.createDataFrame(
        [(1, ["x"], None, None, 5, 1, "u"), (1, ["y"], None, None, 6, 1, "u")],
        "track_id int, tags array<string>, tags_detailed array<struct<name:string>>, similar_tracks array<struct<name:string>>, playcount long, listeners long, lastfm_url string",
    )
    rows = enrichment.merge_sources(base, lyrics, tags, lyrics_order="landed").collect()
    assert sorted((r.track_id, r.name, r.genius and r.genius.lyrics, r.lastfm and r.lastfm.tags) for r in rows) == [
        (1, "m", "new", ["y"]), (1, "n", "new", ["y"]), (2, "o", None, None)
    ]
    assert enrichment.hit_statistics(base, lyrics, tags).first().with_lyrics == 2


def test_statistics_read_only_keys(spark, tmp_path):
    frame = spark.range(10).select(F.col("id").alias("track_id"), F.lit("long").alias("html"))
    frame.write.parquet(str(tmp_path / "side"))
    side = spark.read.parquet(str(tmp_path / "side"))
    assert "html" not in plan(enrichment.hit_statistics(frame.select("track_id"), side, side))


@pytest.mark.parametrize("offset", [0, 3, 40, 990, 2500])
def test_pages_by_text(spark, offset, monkeypatch):
    monkeypatch.setattr(ranking, "PLAIN_OFFSET", 2)
    words = [None, None, ""] + [f"{'ä' if i % 3 else 'zz'}{i * 7919 % 1000}" for i in range(1000)] + ["same"] * 20
    df = spark.createDataFrame([(w,) for w in words], "w string")
    expected = sorted(words, key=lambda w: (w is not None, (w or "").encode()))[offset : offset + 10]
    assert [r.w for r in ranking.page(df, "w", offset, 10).collect()] == expected


def test_projection_keeps_rows_without_a_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 5.0])], "id int, v array<double>")
    got = {r.id: r.out for r in scaling.fit_projection(df, "v", 1).transform(df, "v", "out").collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] is None and len(got[1]) == 1


def test_words_of_other_alphabets_find_their_text(spark):
    texts = spark.createDataFrame([(1, "Música mañana café"), (2, "Привет мир"), (3, "plain words")], "id int, text string")
    found = [r[0] for r in texts.select(text_vectors.tokens(F.col("text"))).collect()]
    assert found == [["música", "mañana", "café"], ["привет", "мир"], ["plain", "words"]]
    rows = text_vectors.fit_hashed_text(texts, "text").transform(texts, "text").collect()
    assert all(sum(x * x for x in r.text_embedding) == pytest.approx(1) for r in rows)


def test_failed_embeddings_are_told_and_bounded(spark):
    def embed(texts):
        raise ImportError("no model here")

    embedded = text_vectors.embed_with(spark.createDataFrame([("a",), ("b",)], "text string"), "text", embed, 1)
    assert tuple(text_vectors.embedding_counts(embedded).first()) == (2, 0, 2)
    with pytest.raises(RuntimeError, match="no model here"):
        text_vectors.require_embedded(embedded, 0.5)
    text_vectors.require_embedded(embedded, 1.0)


def test_autocomplete_reads_the_whole_catalogue(spark):
    rows = spark.range(500).select(F.col("id").alias("track_id"), F.concat(F.lit("t"), F.col("id")).alias("track_name"), F.lit("a").alias("artist_name"))
    assert [r.track_id for r in lookup.autocomplete(rows, "t499").collect()] == [499]
    assert lookup.autocomplete(rows, "t499", pool=100).count() == 0


def test_small_table_computes_its_frame_once(spark):
    counter = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    frame = spark.range(0, 50, 1, 5).mapInArrow(count, "id long")
    assert blocks.small_table(frame, 100).num_rows == 50 and counter.value == 50
