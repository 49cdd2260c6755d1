"""Every registered query against DuckDB on the small tables; those without SQL against brute force."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tests.test_operators import difflib_best

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, (bool, np.bool_, str)):
        return value if isinstance(value, str) else bool(value)
    return float(value) + 0.0


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 10


def test_fuzzy_query(spark, duck):
    parts = duck.execute("SELECT p_partkey, p_name, p_brand FROM part ORDER BY 1").fetchall()
    asked = duck.execute("SELECT min(p_partkey), p_name, p_brand FROM part GROUP BY ALL").fetchall()
    expected = {}
    for query_id, name, artist in asked:
        best = difflib_best((name[:-1], artist), parts)
        if best:
            expected[query_id] = (best[0], round(best[1], 6))
    got = {r.query_id: (r.matched_id, r.score) for r in QUERIES["fuzzy_match"](spark, FOLDER).collect()}
    assert got == expected


def test_fuzzy_resolution_adds_to_the_exact_one(spark):
    exact = {r.query_id: r.matched_id for r in QUERIES["resolve_exact"](spark, FOLDER).collect() if r.matched_id is not None}
    every = {r.query_id: (r.matched_id, r.method) for r in QUERIES["resolve_with_fuzzy"](spark, FOLDER).collect()}
    assert {q: m for q, (m, how) in every.items() if how != "fuzzy"} == exact
    assert any(how == "fuzzy" for _, how in every.values())


def test_projection_query(spark, duck):
    data = np.array([r[0] for r in duck.execute("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()], dtype=float)
    spread, axes = np.linalg.eigh(np.cov(data.T))
    axes = axes[:, ::-1][:, :8]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(8)])
    got = QUERIES["pca_projection"](spark, FOLDER).orderBy("vec_id").collect()
    assert np.array([r.reduced for r in got]) == pytest.approx((data - data.mean(axis=0)) @ axes, abs=1e-5)
    assert got[0].explained == pytest.approx(list(spread[::-1][:8] / spread.sum()), abs=1e-5)
