"""More queries than travel to the tasks: every pair counted, few rows moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import neighbours
from trackweave.plans import recommend

N = 4200


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    return rng.standard_normal((N, 8)), rng.integers(0, 4, N)


@pytest.fixture(scope="module")
def catalogue(spark, vectors):
    rows = [(i, f"t{i}", f"a{a}", "al", v.tolist()) for i, (v, a) in enumerate(zip(*vectors))]
    return spark.createDataFrame(rows, "track_id long, track_name string, artist_name string, album_name string, combined_embedding array<double>").repartition(5)


@pytest.fixture
def moved(monkeypatch):
    """How many candidate rows each search handed on, and by how many queries."""
    counts, stream = [], neighbours.streamed

    def counted(asked, items, search, n_asked, *rest):
        found = stream(asked, items, search, n_asked, *rest).persist()
        counts.append((found.count(), n_asked, search.k))
        return found

    monkeypatch.setattr(neighbours, "streamed", counted)
    return counts


def scores_of(vectors, metric):
    points = vectors[0]
    if metric == "euclidean":
        squares = (points**2).sum(axis=1)
        scores = 1 / (1 + np.sqrt(np.maximum(0, squares[:, None] + squares[None, :] - 2 * points @ points.T)))
    else:
        points = points / np.linalg.norm(points, axis=1)[:, None]
        scores = points @ points.T
    np.fill_diagonal(scores, -np.inf)
    return scores


def ranked(found):
    return sorted((r.query_id, r["rank"], r.track_id) for r in found.select("query_id", "rank", "track_id").collect())


def firsts(scores, k):
    return [(i, place + 1, int(j)) for i, row in enumerate(scores) for place, j in enumerate(np.argsort(-row, kind="stable")[:k])]


def test_widened_recommendations(catalogue, vectors, moved):
    found = recommend.recommend_batch(catalogue, catalogue, k=3, min_similarity=-1.0)
    extra = catalogue.select("track_id", (F.col("track_id") % 5).alias("popularity"))
    wide = recommend.with_features(found, extra, ["popularity"])
    assert ranked(wide) == firsts(scores_of(vectors, "cosine"), 3)
    assert not wide.filter("popularity <> track_id % 5 OR popularity IS NULL").count()
    # Each query is searched in one task here: its k best, one to fill up after the artist filter and one for itself.
    assert moved == [(5 * N, N, 5)]


def test_refilled_recommendations(catalogue, vectors, moved):
    found = recommend.recommend_batch(catalogue, catalogue, k=4, exclude_same_artist=True, min_similarity=-1.0, refill=True)
    scores = scores_of(vectors, "cosine")
    scores[vectors[1][:, None] == vectors[1][None, :]] = -np.inf
    assert ranked(found) == firsts(scores, 4)
    assert moved == [(5 * N, N, 5)]


def test_nearest_by_distance(catalogue, vectors, moved):
    items = catalogue.select("track_id", F.col("combined_embedding").alias("vector"))
    asked = items.withColumnRenamed("track_id", "query_id")
    found = neighbours.nearest(asked, items, 6, "euclidean", exclude=[("query_id", "track_id")])
    assert ranked(found) == firsts(scores_of(vectors, "euclidean"), 6)
    assert moved == [(7 * N, N, 7)]


def test_recommendations_of_other_artists(catalogue, vectors, moved):
    found = recommend.recommend_batch(catalogue, catalogue, k=5, exclude_same_artist=True, min_similarity=0.2)
    scores = scores_of(vectors, "cosine")
    expected = []
    for i, _, j in firsts(scores, 6):
        if vectors[1][i] != vectors[1][j] and scores[i, j] >= 0.2:
            place = 1 + sum(1 for e in expected[-6:] if e[0] == i)
            expected += [(i, place, j)] if place <= 5 else []
    assert ranked(found) == expected
    assert moved == [(7 * N, N, 7)]
