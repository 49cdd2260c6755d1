"""Bounds of balls in bounded pieces, and when balls are not worth a try."""

import numpy as np
import pyarrow as pa
import pytest

from trackweave.operators import metric_blocks


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_bounds_of_balls_come_in_pieces(metric, monkeypatch):
    monkeypatch.setattr(metric_blocks, "TILE_ENTRIES", 10_000)
    rng = np.random.default_rng(6)
    balls = metric_blocks.Balls(metric, rng.standard_normal((300, 4)))
    balls.counts, balls.radii = np.ones(300, np.int64), rng.random(300)
    vectors = rng.standard_normal((2000, 4))
    lists = pa.ListArray.from_arrays(np.arange(0, 8001, 4, dtype=np.int32), vectors.ravel())
    batch = pa.RecordBatch.from_arrays([lists, pa.array(np.full(2000, 0.5))], names=["_vector", "_floor"])
    pieces = list(metric_blocks.in_reach(balls, batch))
    assert all(inside.size <= 10_000 for _, _, inside in pieces)
    assert sum(piece.num_rows for piece, _, _ in pieces) == 2000
    whole = ~(balls.highest(balls.points(lists)) < balls.floor_of(np.full(2000, 0.5))[:, None])
    assert (np.concatenate([inside for _, _, inside in pieces]) == whole).all()


def test_balls_are_only_tried_where_they_may_skip():
    rng = np.random.default_rng(7)
    loose = metric_blocks.unit_rows(rng.standard_normal((3000, 64)))
    tight = np.repeat(rng.standard_normal((60, 64)) * 5, 50, axis=0) + rng.standard_normal((3000, 64)) * 0.1
    for metric in ("cosine", "euclidean", "dot"):
        assert metric_blocks.nothing_to_skip(metric_blocks.Balls(metric, loose[:60]), loose)
        points = metric_blocks.unit_rows(tight) if metric == "cosine" else tight
        assert not metric_blocks.nothing_to_skip(metric_blocks.Balls(metric, points[::50]), points)
