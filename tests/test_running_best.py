"""Many queries: equal vectors searched once, streams of items, bounded pieces."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackweave.operators import metric_blocks, neighbours, running_best
from trackweave.operators.running_best import RunningBest


def exact(metric, q, v):
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)))
    if metric == "cosine":
        q, v = (m / np.where((n := np.linalg.norm(m, axis=1)) == 0, 1, n)[:, None] for m in (q, v))
    return q @ v.T


def best_of(rows, k, metric, same_label=False):
    """The definition: every pair but those of equal ids and, if so said, equal labels; null excludes nothing."""
    ids, labels = [r[0] for r in rows], [r[1] for r in rows]
    scores = np.round(exact(metric, np.array([r[2] for r in rows]), np.array([r[2] for r in rows])), 9)
    found = {}
    for i, own in enumerate(ids):
        others = [j for j in range(len(rows)) if ids[j] != own and not (same_label and labels[j] is not None and labels[j] == labels[i])]
        found[own] = sorted((-scores[i, j], ids[j]) for j in others)[:k]
    return [(q, place + 1, item, -score) for q, hits in sorted(found.items()) for place, (score, item) in enumerate(hits)]


def copies(n=400, vectors=23):
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, size=(vectors, 5)).astype(float)
    base[3] = 0
    return [(i, None if i % 11 == 0 else f"l{i % 3}", base[rng.integers(0, vectors)].tolist()) for i in rng.permutation(n).tolist()]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("labelled", [False, True])
@pytest.mark.parametrize("few", [True, False])
def test_equal_vectors_are_searched_once(spark, metric, labelled, few, monkeypatch):
    rows, told = copies(), []
    search = neighbours._numbered

    def spied(asked, items, found, query_rows, block_rows):
        told.append((asked.count(), items.count()))
        return search(asked, items, found, query_rows if few else 5, block_rows)

    monkeypatch.setattr(neighbours, "_numbered", spied)
    df = spark.createDataFrame(rows, "track_id long, label string, vector array<double>").repartition(4)
    asked = df.withColumnsRenamed({"track_id": "query_id", "label": "own"})
    exclude = [("query_id", "track_id")] + ([("own", "label")] if labelled else [])
    got = neighbours.nearest(asked, df, 6, metric, exclude=exclude, carry=["label"], broadcast_rows=100, block_rows=50)
    got = sorted((r.query_id, r["rank"], r.track_id, round(r.score, 9)) for r in got.collect())
    expected = best_of(rows, 6, metric, labelled)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-8)
    most = 23 * (4 if labelled else 1)
    assert all(n <= most for pair in told for n in pair) and told


def test_repeated_and_missing_ids(spark):
    """An id that many rows have excludes them all; a null id excludes nothing and is one query."""
    rows = [(i % 40 if i % 9 else None, [float(i % 7), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "track_id int, vector array<double>").repartition(3)
    asked = df.withColumnRenamed("track_id", "query_id")
    for k in (2, 20):  # more rows an id than neighbours, and fewer
        options = {"exclude": [("query_id", "track_id")]}
        wide = neighbours.nearest(asked, df, k, "euclidean", broadcast_rows=20, block_rows=30, **options)
        narrow = neighbours.nearest(asked, df, k, "euclidean", **options)
        shown = [sorted((str(r.query_id), r["rank"], r.score) for r in found.collect()) for found in (wide, narrow)]
        assert shown[0] == shown[1]
        assert not wide.filter("query_id = track_id").count()


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("shape", ["plain", "far", "large", "ties", "infinite"])
def test_running_best_equals_all_pairs(metric, shape, monkeypatch):
    monkeypatch.setattr(running_best, "TILE_ENTRIES", 5000)
    rng = np.random.default_rng(5)
    q, v = rng.standard_normal((90, 8)), rng.standard_normal((1500, 8))
    if shape == "far":
        q, v = q * 1e-4 + 1000, v * 1e-4 + 1000
    if shape == "large":
        q, v = q * 1e20, v * 1e20
    if shape == "ties":
        q, v = np.round(q), np.round(v)
        v[:700] = v[0]
    if shape == "infinite":
        v[[3, 900], 2], q[7, 1], v[5, 0] = np.inf, -np.inf, np.nan
    as_points = metric_blocks.unit_rows if metric == "cosine" else np.asarray
    with np.errstate(all="ignore"):
        found = RunningBest(7, metric, np.arange(90), as_points(q), [pa.array(np.arange(90) % 4)])
        for start in range(0, 1500, 400):
            numbers = np.arange(start, min(1500, start + 400))
            found.add(numbers, as_points(v)[numbers], [pa.array(numbers % 5)])
        got = found.found().to_pandas()
        scores = np.round(exact(metric, q, v), 9 if shape != "far" else 12)
    for i in range(90):
        allowed = [j for j in range(1500) if i % 4 != j % 5 and not np.isnan(scores[i, j])]
        expected = sorted(allowed, key=lambda j: (-scores[i, j], j))[:7]
        mine = got[got._asked == i]._item.tolist()
        if shape in ("plain", "ties", "infinite"):
            assert mine == expected
        else:
            # Beyond the digits that the definition here has.
            assert np.allclose(scores[i, mine], scores[i, expected], rtol=1e-9)


def test_ties_do_not_pile_up(monkeypatch):
    """All pairs tie: only the first items are ever kept, and later ones are no candidates."""
    monkeypatch.setattr(running_best, "TILE_ENTRIES", 20_000)
    best, waited = RunningBest(5, "dot", np.arange(100), np.zeros((100, 3)), []), []
    merge = best._merge
    monkeypatch.setattr(best, "_merge", lambda: (waited.append(best.n_waiting), merge()))
    best.add(np.arange(20_000), np.zeros((20_000, 3)), [])
    assert max(waited) <= 100 * 10 and sum(waited) <= 100 * 10
    assert best.found().column("_item").to_pylist() == [0, 1, 2, 3, 4] * 100


def test_a_stream_keeps_k_rows_a_query_however_many_items(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(3000)]
    items = spark.createDataFrame(rows, "_item long, _vector array<double>").repartition(7)
    asked = items.filter("_item < 200").withColumnRenamed("_item", "_asked")
    found = running_best.streamed(asked, items, running_best.NumberedSearch(3, "dot", []), 200, 3000, 50)
    assert found.count() == 600
    assert found.filter(F.col("_asked") == 0).count() == 3


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_tiles_are_pieces_of_queries_and_items(metric, monkeypatch):
    """Of many queries a tile holds some only, and only groups of items that may matter are looked at pair by pair."""
    monkeypatch.setattr(running_best, "TILE_ENTRIES", 4000)
    monkeypatch.setattr(running_best, "TILE_QUERIES", 40)
    rng = np.random.default_rng(6)
    q, v = rng.standard_normal((130, 8)), rng.standard_normal((1501, 8))
    v[900:1000] = v[0]
    q[[7, 129], 1] = np.inf
    as_points = metric_blocks.unit_rows if metric == "cosine" else np.asarray
    with np.errstate(all="ignore"):
        best, sizes = RunningBest(7, metric, np.arange(130), as_points(q), []), []
        likely = best._likely
        monkeypatch.setattr(best, "_likely", lambda piece, rough, longest: (sizes.append((len(best.lengths[piece]), len(rough))), likely(piece, rough, longest))[1])
        for numbers in np.array_split(np.arange(1501), 3):
            best.add(numbers, as_points(v)[numbers], [])
        got = best.found().to_pandas()
        scores = np.round(exact(metric, q, v), 9)
    for i in set(range(130)) - {7, 129}:
        assert got[got._asked == i]._item.tolist() == sorted(range(1501), key=lambda j: (-scores[i, j], j))[:7]
    assert max(n for n, _ in sizes) == 40 and max(n for _, n in sizes) == 100


def test_kinds_are_told_apart_by_a_number_first(spark, monkeypatch):
    """Vectors are compared where numbers agree; zeros of both signs and all NaN stay alike, as are missing labels."""
    shapes = [[0.0, 1.0], [-0.0, 1.0], [float("nan"), 1.0], [2.0, -1.0]]
    rows = [(i, None if i % 2 else "a", shapes[i % 4] if i % 3 else shapes[0]) for i in range(60)]
    keys, sizes = [], []
    best, search = neighbours.top_n_per_group, neighbours._numbered
    monkeypatch.setattr(neighbours, "top_n_per_group", lambda df, by, *rest: (keys.append(by), best(df, by, *rest))[1])
    monkeypatch.setattr(neighbours, "_numbered", lambda asked, items, *rest: (sizes.append((asked.count(), items.count())), search(asked, items, *rest))[1])
    df = spark.createDataFrame(rows, "track_id long, label string, vector array<double>").repartition(3)
    asked = df.withColumnsRenamed({"track_id": "query_id", "label": "own"})
    exclude = [("query_id", "track_id"), ("own", "label")]
    found = neighbours.nearest(asked, df, 4, "dot", exclude=exclude, broadcast_rows=10, block_rows=20)
    # Labels a and null; the kinds of vectors are zero with one, NaN with one, and two with minus one.
    kinds = {(label, "zero" if v[0] == 0 else "nan" if v[0] != v[0] else "two") for _, label, v in rows}
    assert sizes == [(len(kinds), len(kinds))]
    assert [by[0] for by in keys if "_vector" in by] == ["_hash"]
    # Nothing is near to what is no number.
    assert found.select("query_id").distinct().count() == sum(v[0] == v[0] for _, _, v in rows)


def test_distances_by_pieces_of_queries_far_from_the_origin(monkeypatch):
    """Each piece has the bounds of its own queries, around the mean of all."""
    monkeypatch.setattr(running_best, "TILE_ENTRIES", 3000)
    monkeypatch.setattr(running_best, "TILE_QUERIES", 30)
    rng = np.random.default_rng(9)
    q, v = rng.standard_normal((75, 6)) + 1000, rng.standard_normal((1200, 6)) * np.linspace(0.1, 3, 1200)[:, None] + 1000
    best = RunningBest(5, "euclidean", np.arange(75), q, [])
    best.add(np.arange(1200), v, [])
    got, scores = best.found().to_pandas(), np.round(exact("euclidean", q, v), 12)
    for i in range(75):
        assert got[got._asked == i]._item.tolist() == sorted(range(1200), key=lambda j: (-scores[i, j], j))[:5]


def test_queries_of_many_partitions_are_gathered(spark, monkeypatch):
    """Partitions of a few rows would each write a file for all others."""
    parts, join = [], neighbours._with_kind
    monkeypatch.setattr(neighbours, "_with_kind", lambda rows, *rest: (parts.append(rows.rdd.getNumPartitions()), join(rows, *rest))[1])
    many = 4 * spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "track_id long, vector array<double>")
    found = neighbours.nearest(df.withColumnRenamed("track_id", "query_id").repartition(many), df, 2, "dot", broadcast_rows=20)
    assert found.count() == 600
    assert parts[-1] == many // 2


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("labelled", [False, True])
def test_few_pairs_are_summed_again(metric, labelled, monkeypatch):
    """The first items tell what the k best must reach, so few pairs are proposed; items that a label excludes tell nothing."""
    rng = np.random.default_rng(12)
    q, v = rng.standard_normal((64, 16)), rng.standard_normal((4000, 16))
    # Most of the nearest items are those that the label excludes.
    v[::4] = q[rng.integers(0, 64, 1000)] + 0.01 * rng.standard_normal((1000, 16))
    if not labelled:
        v[::4] = rng.standard_normal((1000, 16))
    codes = np.where(np.arange(4000) % 4 == 0, 1, 2)
    as_points = metric_blocks.unit_rows if metric == "cosine" else np.asarray
    q, v = as_points(q), as_points(v)
    best, proposed = RunningBest(5, metric, np.arange(64), q, [pa.array(np.ones(64, int))] if labelled else []), []
    propose = best._propose
    monkeypatch.setattr(best, "_propose", lambda rows, *rest: (proposed.append(rows), propose(rows, *rest)))
    best.add(np.arange(4000), v, [pa.array(codes)] if labelled else [])
    got, scores = best.found().to_pandas(), np.round(exact(metric, q, v), 12)
    allowed = np.flatnonzero(codes == 2) if labelled else np.arange(4000)
    for i in range(64):
        assert got[got._asked == i]._item.tolist() == sorted(allowed.tolist(), key=lambda j: (-scores[i, j], j))[:5]
    if not labelled:
        # Without what the first items tell, each doubling of the items proposes some again: above 35 a query.
        assert len(np.concatenate(proposed)) < 20 * 64


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_first_items_that_tell_little(metric):
    """Fewer items than neighbours, all equal, next to no candidate, no numbers among them, very large or very small ones."""
    rng = np.random.default_rng(13)
    as_points = metric_blocks.unit_rows if metric == "cosine" else np.asarray
    for shape in ("few", "equal", "excluded", "nan", "large", "small"):
        v = rng.standard_normal((5 if shape == "few" else 300, 4))
        v = {"equal": np.ones_like(v), "large": v * 1e18, "small": v * 1e-9}.get(shape, v)
        if shape == "nan":
            v[10:290] = np.nan
        labels = np.zeros(len(v), int) if shape == "excluded" else np.ones(len(v), int)
        if shape == "excluded":
            labels[[3, 200]] = 1
        with np.errstate(all="ignore"):
            best = RunningBest(9, metric, np.arange(20), as_points(v[:5].repeat(4, axis=0)), [pa.array(np.zeros(20, int))])
            # The first piece has less than is wanted.
            for numbers in np.split(np.arange(len(v)), [4, 150]):
                best.add(numbers, as_points(v)[numbers], [pa.array(labels[numbers])])
            got, scores = best.found().to_pandas(), np.round(exact(metric, v[:5].repeat(4, axis=0), v), 12)
        for i in range(20):
            allowed = [j for j in np.flatnonzero(labels).tolist() if not np.isnan(scores[i, j])]
            expected = sorted(allowed, key=lambda j: (-scores[i, j], j))[:9]
            mine = got[got._asked == i]._item.tolist()
            assert len(mine) == len(expected), shape
            if shape in ("large", "small"):
                # Sums of other order differ in the last digits.
                assert np.allclose(scores[i, mine], scores[i, expected], rtol=1e-9, atol=1e-11), shape
            else:
                assert mine == expected, shape
