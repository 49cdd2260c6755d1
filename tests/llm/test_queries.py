"""The registered queries on the small tables against brute force, and the pipeline against its stages done plainly."""

import os
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import brute_passages
from trackweave.llm import packing, quality_rules

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def answer(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_packing_query(spark, rows):
    got = answer(spark, "op1_packing")
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(brute.WORD.findall(t or ""))) for i, t in rows]
    counts = {}
    for r in got:
        counts[r.n_tokens] = counts.get(r.n_tokens, 0) + 1
    edges = packing.best_boundaries(sorted(counts.items()), packing.BUCKETS)
    assert {r.bucket_length for r in got} == set(edges)
    assert all(r.padding == r.bucket_length - r.n_tokens >= 0 for r in got)


def test_chunk_query(spark, rows):
    got = [(r.doc_id, r.removed_words) for r in answer(spark, "op3_chunk_dedup")]
    assert sorted(got, key=repr) == brute_passages(rows)


def test_repetition_query(spark, rows):
    got = {r.doc_id: r for r in answer(spark, "op4_suffix_array_repetition")}
    assert len(got) == len(rows)
    for i, text in rows:
        if len(text or "") < 3000:
            n, chars, symbols, lines, repeated, covered, longest = brute.repetition(text, 4)
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
            assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
            assert r.kept == (not r.base_failed and covered <= 0.4 * n and longest <= 200)


def test_near_duplicate_query(spark, rows):
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in answer(spark, "op5_vantage_simhash")], key=repr)
    assert got == brute.near(rows)


def test_token_count_query(spark, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    got = answer(spark, "op6_token_counts")
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_sharding_query(spark, rows):
    got = answer(spark, "op7_kd_sharding")
    expected = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert {r["shard"] for r in got} <= set(range(24))
    for shard in range(24):
        slots = sorted(r.slot for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_codec_query(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in answer(spark, "op8_word_table_bpe")]
    assert sorted(got) == expected


def test_language_model_query(spark):
    labels = {i: (q, t) for i, q, t in duckdb.sql(f"SELECT * FROM '{FOLDER}/labels.parquet'").fetchall()}
    got = {r.doc_id: r.kept for r in answer(spark, "op9_kneser_ney_quality")}
    good = [got[i] for i, label in labels.items() if label[0] == 1]
    bad = [got[i] for i, label in labels.items() if label[0] == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_pipeline(spark, rows):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    texts = dict(rows)
    found = quality_rules.measure([t for _, t in rows], 4)
    kept = []
    for k, (i, _) in enumerate(rows):
        n, repeated, covered, longest = (found[c][k] for c in ("n_words", "n_repeat_words", "n_covered_words", "longest_repeat"))
        if n >= 20 and 100 * repeated <= 30 * n and covered <= 0.4 * n and longest <= 200:
            kept.append(i)
    kept = [i for i, keep, *_ in brute.exact([(i, texts[i]) for i in kept]) if i == keep]
    kept = [i for i, _, root in brute.near([(i, texts[i]) for i in kept]) if i == root]
    removed = dict(brute_passages([(i, texts[i]) for i in sorted(kept)]))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {i: len(brute.WORD.findall(texts[i])) - removed[i] for i in kept}


def test_stages_return_the_columns_of_documents(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()


def test_stages_keep_columns_of_any_name(spark, awkward):
    named = ["kept", "N_words", "Removed_Words", "a.b", "longest_repeat", "_doc", "Base_Failed", "held_by", "_file", "Column_3"]
    docs = awkward.toDF(*awkward.columns[:5], *named)
    marked = docs.withColumn("kept", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, marked, FOLDER)
        assert got.columns == docs.columns
        assert {(row[5], *row[6:]) for row in got.collect()} == {("mine", *["extra"] * 9)}
    corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()
