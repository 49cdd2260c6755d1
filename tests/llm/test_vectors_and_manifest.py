"""One-bit codes, whitening and the Merkle manifest against plain versions, on awkward rows and on the small tables."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_module
from tests.llm import brute
from tests.llm.conftest import awkward_rows
from trackweave.llm import bit_codes, merkle, whitening

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
HERE = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

EXTRA = ["_id", "_vector", "_hash", "first", "x", "code", "rank", "count", "d", "_metadata", "a.b"]
VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(name, T.StringType()) for name in EXTRA]
)


def vector_rows(n=400, dim=20):
    rng = np.random.default_rng(3)
    vectors = [[float(v) for v in rng.standard_normal(dim).astype(np.float32)] for _ in range(n)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    # A vector that a third of the rows hold, some of them queries.
    rows += [(n + i, vectors[40]) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None), (1020, [0.0] * dim), (1040, [None] + [1.0] * (dim - 1)), (1060, [nan] * dim), (1080, [inf] * dim)]
    rows += [(1100, []), (1120, [1.0] * (dim + 1)), (None, vectors[5]), (7, vectors[7]), (1140, [-0.0] * (dim - 1) + [2.0])]
    rows += [(1160, vectors[60]), (1160, vectors[61])]
    return [(*row, *["extra"] * len(EXTRA)) for row in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS)


@pytest.fixture(scope="module")
def no_vectors(spark):
    return spark.createDataFrame([], VECTORS)


# --- one-bit codes ------------------------------------------------------------------------------


def brute_neighbours(rows, k, every):
    """Lists of (rank, vec_id, score) per query id."""
    own = {}
    lengths = [len(v) for i, v, *_ in rows if i is not None and usable(v)]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d), default=0)
    for i, v, *_ in rows:
        if i is not None and usable(v) and len(v) == dim:
            own[i] = min(own.get(i, v), v)
    ids = np.array(sorted(own))
    x = np.array([own[i] for i in ids], dtype=np.float64).reshape(len(ids), dim)
    out = {}
    for place, i in enumerate(ids):
        if i % every == 0:
            scores = np.einsum("ij,ij->i", np.broadcast_to(x[place], x.shape), x)
            order = [j for j in np.lexsort((ids, -scores)) if j != place][:k]
            out[int(i)] = [(r, int(ids[j]), float(scores[j])) for r, j in enumerate(order, 1)]
    return out


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector) and any(vector)


def lists(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    return out


def recall(got, expected):
    wanted = sum(len(v) for v in expected.values())
    return sum(len({x[1] for x in got[q]} & {x[1] for x in expected[q]}) for q in expected) / wanted


@pytest.mark.parametrize("query_rows", [bit_codes.QUERY_ROWS, 8])
def test_neighbours_on_awkward_rows(vectors, query_rows):
    expected = brute_neighbours(vector_rows(), 20, 20)
    got = lists(bit_codes.nearest_by_codes(vectors, query_rows=query_rows, block_rows=100))
    assert set(got) == set(expected) and recall(got, expected) >= 0.99
    # What is found has its exact score and is in order; lists found whole are the same, ties included.
    for query, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and query not in {i for _, i, _ in found}
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
    assert sum(got[q] == expected[q] for q in expected) >= 0.95 * len(expected)


def test_few_candidates_and_none(spark, no_vectors):
    assert bit_codes.nearest_by_codes(no_vectors).collect() == []
    rows = [(0, [1.0, 2.0]), (20, [3.0, -1.0]), (21, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert lists(bit_codes.nearest_by_codes(df)) == brute_neighbours(rows, 20, 20)
    one = spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")
    assert bit_codes.nearest_by_codes(one).collect() == []


def test_error_bounds_hold_and_spare_rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 100)) + rng.standard_normal(100)
    coder = bit_codes.Coder(100, x.mean(axis=0))
    assert np.allclose(coder.rotation() @ coder.rotation().T, np.eye(100))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list(x)), pa.array([[i] for i in range(3000)])], names=["_vector", "ids"])
    coded = pa.Table.from_batches(list(coder.encode(iter([batch]))))
    asked = pa.table([pa.array(range(50)), pa.array(list(x[:50]))], names=["first", "_vector"])
    found = bit_codes._Found(asked, coder, 21, bit_codes.EPSILON)
    estimate, error = found.estimates(coded)
    true = x[:50] @ x.T
    assert np.mean(np.abs(true - estimate) <= error) >= 0.995
    # Most rows cannot reach the best 21.
    floor = np.partition(true, 3000 - 21, axis=1)[:, 3000 - 21]
    assert np.mean(estimate + error >= floor[:, None]) < 0.5


@HERE
def test_neighbour_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    expected = brute_neighbours([(i, list(v)) for i, v in rows], 20, 20)
    got = lists(QUERIES["op11_bit_code_neighbours"](spark, FOLDER))
    assert set(got) == set(expected) and recall(got, expected) >= 0.99


# --- whitening ----------------------------------------------------------------------------------


def brute_whitening(rows, components=4):
    own = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in own]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d), default=0)
    own = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in own if len(v) == dim]
    fit = np.array(sorted({x for _, x in own}), dtype=np.float64)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    sums = [sum(int(x) for x in column) for column in fit.T]
    out = []
    for i, x in own:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        white = (np.array(x) - mean) @ vectors / np.sqrt(values)
        out.append((i, n, deviation, white))
    return out, values


def check_whitening(got, rows):
    expected, values = brute_whitening(rows)
    trace = sum(v.explained for v in {r.component: r for r in got}.values()), values.sum()
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    signs = {}
    assert len(got) == 4 * len(expected)
    for i, n, deviation, white in expected:
        for r in by[i, deviation]:
            signs.setdefault(r.component, np.sign(r.whitened * white[r.component - 1]) or 1.0)
            assert r.n == n and abs(r.whitened - signs[r.component] * white[r.component - 1]) < 1e-9
            assert r.identity_error < 1e-10
    assert trace[0] <= 1 + 1e-12


def test_whitening_of_awkward_rows(vectors, no_vectors):
    check_whitening(whitening.whiten(vectors).collect(), vector_rows())
    empty = whitening.whiten(no_vectors)
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_whitening_without_variance_and_of_large_numbers(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, None)}
    # On a line: one component with variance, one without.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    got = {r.component: r for r in whitening.whiten(line).filter("vec_id = 8").collect()}
    assert abs(got[1].explained - 1) < 1e-12 and got[2].whitened is None and got[1].identity_error < 1e-12
    large = [(i, [1e30 if i == 3 else 1e12 * i, float(i % 2)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 12 and all(r.deviation is None for r in got)
    far = [(i, [4e15 + i, float(i % 3)]) for i in range(30)]
    check = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>"), components=1).collect()
    assert max(r.identity_error for r in check) < 1e-10


def test_spectrum_slicing_against_a_library():
    rng = np.random.default_rng(11)
    repeated = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    cases = [np.cov(rng.standard_normal((6, 40))), np.zeros((3, 3)), np.eye(5), np.array([[2.0]])]
    cases += [repeated @ np.diag([9, 9, 9, 4, 4, 1] + [0] * 6) @ repeated.T, np.diag([1e-9, 1.0, 1 + 1e-9, 1 - 1e-9])]
    for matrix in cases:
        matrix = (matrix + matrix.T) / 2
        expected = np.linalg.eigvalsh(matrix)[::-1]
        values, vectors = whitening.leading(matrix, min(4, len(matrix)))
        scale = max(1e-300, abs(expected[0]))
        assert np.abs(values - expected[: len(values)]).max() <= 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * scale
        for shift in (-0.5, 0.3, 0.99999999999, 5.0):
            assert whitening.count_above(matrix, shift) == (expected > shift).sum()


@HERE
def test_whitening_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet'").fetchall()
    check_whitening(QUERIES["op12_spectrum_whitening"](spark, FOLDER).collect(), [(i, list(v)) for i, v in rows])


# --- manifest -----------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def path(nodes, place):
    """Siblings upwards of the leaf at a place, and the top."""
    steps = []
    while len(nodes) > 1:
        start = place - place % 8
        run = nodes[start : start + 8]
        steps.append((place - start, run[: place - start] + run[place - start + 1 :]))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        place //= 8
    return steps, nodes[0]


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). Sorted (doc_id, leaf, subroot, root, proof digest, folded)."""
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda r: r[:3])
    subroots = [path([r[2] for r in by[lang]], 0)[1] for lang in langs]
    out = []
    for number, lang in enumerate(langs):
        above, root = path(subroots, number)
        for place, (_, _, leaf, row) in enumerate(by[lang]):
            steps = path([r[2] for r in by[lang]], place)[0] + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            lowered = None if row[4] is None else brute.lower(row[4])
            node = leaf_of((*row[:4], lowered)) if tampered else leaf
            for at, siblings in steps:
                node = sha("".join([*siblings[:at], node, *siblings[at:]]))
            proof = sha("".join(s for _, siblings in steps for s in siblings))
            out.append((row[0], leaf, subroots[number], root, proof, node))
    return sorted(out, key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_rows(df):
    df = df.withColumn("p", merkle.proof_digest(F.col("proof"))).withColumn("f", merkle.fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "p", "f").collect()], key=repr)


def altered():
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = merkle.leaf_digest([*map(F.col, FIELDS[:-1]), lowered])
    return {"altered": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf)}


@pytest.mark.parametrize("block", [merkle.BLOCK, 5])
def test_manifest_of_awkward_rows(awkward, nothing, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in awkward_rows()]
    assert manifest_rows(merkle.manifest(awkward, FIELDS, also=altered())) == brute_manifest(rows)
    empty = merkle.manifest(nothing, FIELDS, also=altered())
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof", "altered"] and empty.count() == 0


def test_manifest_of_many_groups_and_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(i if i % 11 else 1, None, "big" if i % 3 else f"l{rng.randint(0, 90)}", i, f"Text {i % 11 and i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_rows(merkle.manifest(df, FIELDS, also=altered())) == brute_manifest(rows)


def test_blocks_need_the_least_set_of_nodes():
    rng = random.Random(4)
    for size in (1, 2, 8, 9, 64, 65, 300, 1000):
        leaves = [sha(str(i)) for i in range(size)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        for _ in range(5):
            start = rng.randrange(size)
            n = rng.randint(1, size - start)
            wanted = merkle.missing_nodes(start, n, size)
            # The union over the leaves of what their paths need, less what the leaves themselves give.
            union, known = set(), {(0, i) for i in range(start, start + n)}
            for level in range(len(levels) - 1):
                for _, place in [k for k in known if k[0] == level]:
                    first = place - place % 8
                    union |= {(level, i) for i in range(first, min(first + 8, len(levels[level])))} - known
                known |= {(level + 1, p // 8) for lv, p in known if lv == level}
            assert len(wanted) == len(set(wanted)) and set(wanted) == union
            nodes = {(level, i): levels[level][i] for level, i in wanted}
            proofs, top = merkle.proofs_of(leaves[start : start + n], start, size, nodes)
            assert top == levels[-1][0] and len(proofs) == n


@HERE
def test_manifest_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{FOLDER}/documents.parquet'").fetchall()
    got = QUERIES["op13_octopus_manifest"](spark, FOLDER).collect()
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert sorted([tuple(r[c] for c in columns) for r in got], key=repr) == brute_manifest(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and not all(r.verified for r in got)
