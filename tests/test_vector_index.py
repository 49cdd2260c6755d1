"""The stored index of vectors against exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tests.test_operators import clusters
from trackweave.operators import neighbours, vector_index

FOLDER = "/root/testdata/sf0.01"


def found(df):
    return sorted((r.query_id, r["rank"], r.track_id, r.score) for r in df.collect())


def recall(got, expected):
    wanted = {(q, i) for q, _, i, _ in expected}
    return len(wanted & {(q, i) for q, _, i, _ in got}) / len(wanted)


@pytest.fixture(scope="module")
def rows(spark):
    extra = spark.createDataFrame([(5000, None), (5001, [0.0] * 6)], "track_id long, vector array<double>")
    return clusters(spark, 2000).unionByName(extra).withColumn("artist_name", F.concat(F.lit("a"), F.col("track_id") % 7))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_all_lists_give_the_exact_rows_and_few_give_most(spark, rows, metric, tmp_path):
    index = vector_index.build_index(rows, str(tmp_path / "index"), 5, metric, carry=["artist_name"])
    index = vector_index.open_index(spark, index.folder)
    asked = rows.filter("track_id % 50 = 0").select(F.col("track_id").alias("query_id"), "vector")
    options = {"carry": ["artist_name"], "exclude": [("query_id", "track_id")]}
    expected = found(neighbours.nearest(asked, rows, 5, metric, **options))
    lists = len(index.balls.centres)
    # Small limits: long lists and lists that many queries probe are met by several tasks.
    assert found(index.nearest(asked, 5, probes=lists, query_rows=10, block_rows=100, **options)) == expected
    assert 1 <= index.probes < lists
    assert recall(found(index.nearest(asked, 5, **options)), expected) >= 0.9
    assert index.nearest(asked, 5, **options).columns == ["query_id", "track_id", "artist_name", "score", "rank"]


def test_only_probed_lists_are_read(spark, rows, tmp_path):
    index = vector_index.build_index(rows, str(tmp_path / "index"), lists=12)
    assert index.lists().count() == 2001  # every row with a vector
    assert int(index.balls.counts.sum()) == 2001
    one = rows.filter("track_id = 1999").select(F.col("track_id").alias("query_id"), "vector")
    plan = index.nearest(one, 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_centre" in plan or "PartitionFilters: [(_centre" in plan or "_centre IN" in plan
    assert index.nearest(one.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        index.nearest(one, 0)
    with pytest.raises(ValueError):
        vector_index.build_index(rows.limit(0), str(tmp_path / "none"))


def test_probes_follow_the_sample():
    rng = np.random.default_rng(0)
    far = np.repeat(np.eye(4) * 100, 50, axis=0) + rng.standard_normal((200, 4))
    balls = vector_index.Balls("euclidean", np.eye(4) * 100)
    assert vector_index.probes_for(balls, far, 5, 0.95) == 1
    mixed = rng.standard_normal((400, 4))
    balls = vector_index.Balls("euclidean", mixed[:40])
    assert 1 < vector_index.probes_for(balls, mixed, 5, 0.95) <= vector_index.probes_for(balls, mixed, 5, 1.0) <= 40


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_index_query_finds_nine_of_ten(spark):
    got = entry_module.queries()["ann_neighbours"](spark, FOLDER).withColumnRenamed("similarity_score", "score")
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("vector"))
    asked = rows.filter("track_id % 100 = 0").withColumnRenamed("track_id", "query_id")
    exact = neighbours.nearest(asked, rows, 10, exclude=[("query_id", "track_id")])
    assert recall(found(got), found(exact)) >= 0.9
