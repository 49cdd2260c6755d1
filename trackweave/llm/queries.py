"""Every operator of this folder applied to the whole given tables, next to SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.bindings.registry import Registered
from trackweave.llm import (
    bit_codes,
    exact_dedup,
    line_dedup,
    merkle,
    ngram_quality,
    packing,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    whitening,
    word_codec,
)
from trackweave.llm.common import ascii_lower

QUERIES: dict[str, Registered] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = Registered(run, sql)
        return run

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query(
    "op2_exact_dedup",
    f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
    WINDOW same AS (PARTITION BY t)
    """,
)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # Two batches, so that rows meet the state that others have left.
    docs, store = documents(spark, folder), exact_dedup.DedupStore.create(spark)
    later = F.coalesce(F.col("doc_id") % 2 != 0, F.lit(False))
    store.add(docs.filter(~later))
    decided = exact_dedup.exact_dedup(docs.filter(later), store=store)
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op10_line_dedup",
    rf"""
    WITH lines AS (
        SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ), keyed AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
        FROM lines
    ), frequent AS (
        SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), judged AS (
        SELECT k.*, keep_id IS NOT NULL AND doc_id <> keep_id AS dropped FROM keyed k LEFT JOIN frequent USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_lines(documents(spark, folder))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_kd_sharding")
def op7_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.kd_shards(documents(spark, folder), shards=24)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


@query("op4_suffix_array_repetition")
def op4_suffix_array_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(documents(spark, folder), carry=["doc_id"])


@query("op5_vantage_simhash")
def op5_vantage_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_word_table_bpe")
def op8_word_table_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = word_codec.encode_and_decode(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_chunk_dedup")
def op3_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.without_repeated_passages(documents(spark, folder).select("doc_id", "text"))
    return cut.select("doc_id", "text", "removed_words", "removed_spans", "held_by")


@query("op9_kneser_ney_quality")
def op9_kneser_ney_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return ngram_quality.judged(documents(spark, folder), labels)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


@query("op11_bit_code_neighbours")
def op11_bit_code_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return bit_codes.nearest_by_codes(embeddings(spark, folder))


@query("op12_spectrum_whitening")
def op12_spectrum_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, folder))


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(text: str) -> str:
    values = [text if name == "text" else f"CAST({name} AS VARCHAR)" for name in MANIFEST_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({value}) || ':' || {value}, '-')" for value in values) + ")"


def _tree_sql(tree: str, leaves: str) -> str:
    """Nodes of one tree per ``key`` over the table ``leaves``, and per node what stands beside it."""
    return f"""
    {tree} AS (
        SELECT key, 0 AS level, place, leaf AS digest, size FROM {leaves}
        UNION ALL
        SELECT key, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), any_value((size + 7) // 8)
        FROM {tree} WHERE size > 1 GROUP BY key, level, place // 8
    ), {tree}_beside AS (
        SELECT n.key, n.level, n.place,
            coalesce(string_agg(m.digest, '' ORDER BY m.place) FILTER (m.place < n.place), '') AS before,
            coalesce(string_agg(m.digest, '' ORDER BY m.place) FILTER (m.place > n.place), '') AS after
        FROM {tree} n JOIN {tree} m ON m.key = n.key AND m.level = n.level AND m.place // 8 = n.place // 8
        WHERE n.size > 1 GROUP BY n.key, n.level, n.place
    ), {tree}_walk AS (
        SELECT id, key, 0 AS level, place, leaf, node, '' AS proof FROM {leaves}_from
        UNION ALL
        SELECT id, key, w.level + 1, w.place // 8, leaf, sha256(before || node || after), proof || before || after
        FROM {tree}_walk w JOIN {tree}_beside USING (key, level, place)
    ), {tree}_end AS (
        SELECT id, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM {tree}_walk GROUP BY id
    ), {tree}_top AS (SELECT key, arg_max(digest, level) AS digest FROM {tree} GROUP BY key)"""


@query(
    "op13_octopus_manifest",
    f"""
    WITH RECURSIVE digested AS (
        SELECT doc_id, row_number() OVER () AS id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS key,
            {_leaf_sql("text")} AS leaf,
            -- CRC-32 of the decimal id, bit by bit.
            xor(4294967295, list_reduce(
                [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
                lambda crc, c: list_reduce([xor(crc, c)] || range(8), lambda r, i: xor(r >> 1, (r & 1) * 3988292384)))) AS crc,
            {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS altered
        FROM documents
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS size
        FROM digested
    ), leaves_from AS (SELECT *, CASE WHEN crc % 3 = 0 THEN altered ELSE leaf END AS node FROM leaves),
    {_tree_sql("tree", "leaves")},
    subroots AS (
        SELECT '' AS key, key AS of_key, digest AS leaf, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS size
        FROM tree_top
    ), subroots_from AS (
        SELECT e.id, s.key, s.place, s.leaf, e.node
        FROM tree_end e JOIN leaves l USING (id) JOIN subroots s ON s.of_key = l.key
    ),
    {_tree_sql("crown", "subroots")}
    SELECT doc_id, l.leaf, s.leaf AS subroot, c.digest AS root, sha256(t.proof || e.proof) AS proof_sha256,
        e.node AS folded_root, e.node = c.digest AS verified
    FROM leaves l JOIN tree_end t USING (id) JOIN crown_end e USING (id) JOIN subroots s ON s.of_key = l.key CROSS JOIN crown_top c
    """,
)
def op13_octopus_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    altered = F.when(chosen, merkle.leaf_digest([*map(F.col, MANIFEST_FIELDS[:-1]), ascii_lower(F.col("text"))]))
    proved = merkle.manifest(docs, MANIFEST_FIELDS, also={"altered": altered})
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("proof"))
    listed = proved.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return listed.withColumn("verified", F.col("folded_root") == F.col("root"))
