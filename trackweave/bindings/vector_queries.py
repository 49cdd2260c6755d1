"""Scaling, projection, text vectors, hybrid vectors, pair similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackweave.bindings.registry import query
from trackweave.bindings.stand_ins import CATALOGUE, catalogue, select_sql, table, texts
from trackweave.functions.text import build_document, expand_query
from trackweave.functions.vectors import as_vector, hybrid_vector, l2_normalize, similarity
from trackweave.operators.quality import vector_coverage
from trackweave.operators.scaling import feature_vectors, fit_projection
from trackweave.operators.text_vectors import embed_with, fit_hashed_text
from trackweave.plans.embed import build_vectors
from trackweave.plans.transform import build_features

# --- scalers ------------------------------------------------------------------------------------

# Price with gaps (median fill), size, and a constant column.
_MEASURES = {
    "track_id": "p_partkey",
    "price": "CASE WHEN p_partkey % 9 <> 4 THEN p_retailprice END",
    "size": "CAST(p_size AS DOUBLE)",
    "same": "CAST(7 AS DOUBLE)",
}
_FILLED = f"""
    raw AS ({select_sql(_MEASURES)}),
    m AS (SELECT track_id, coalesce(price, (SELECT median(price) FROM raw)) AS price, size, same FROM raw)
"""


def _scaled(spark, folder, kind):
    rows = table(spark, folder, "part").select(*[F.expr(text).alias(name) for name, text in _MEASURES.items()])
    scaled = feature_vectors(rows, ["price", "size", "same", "absent"], kind)
    parts = [F.round(F.get("feature_embedding", F.lit(i)), 6).alias(n) for i, n in enumerate(("price", "size", "same"))]
    return scaled.select("track_id", *parts, "feature_dimension")


def _scaler_sql(center: str, scale: str) -> str:
    listed = ", ".join(
        f"round((m.{c} - s.{c}_c) / CASE WHEN s.{c}_s = 0 THEN 1 ELSE s.{c}_s END, 6) AS {c}" for c in ("price", "size", "same")
    )
    stats = ", ".join(f"{center.format(c=c)} AS {c}_c, {scale.format(c=c)} AS {c}_s" for c in ("price", "size", "same"))
    return f"WITH {_FILLED}, s AS (SELECT {stats} FROM m) SELECT track_id, {listed}, 3 AS feature_dimension FROM m, s"


@query("scale_standard", _scaler_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, folder):
    return _scaled(spark, folder, "standard")


@query("scale_minmax", _scaler_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


@query("scale_robust", _scaler_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scale_robust(spark, folder):
    return _scaled(spark, folder, "robust")


# --- projection ---------------------------------------------------------------------------------


@query("pca_projection")
def pca_projection(spark, folder):
    """64 dimensions to 8, with the share of variance each component explains."""
    rows = table(spark, folder, "embeddings")
    projection = fit_projection(rows, "embedding", 8)
    reduced = projection.transform(rows, "embedding", "reduced")
    ratio = F.array(*[F.lit(round(x, 6)) for x in projection.explained_variance_ratio])
    return reduced.select("vec_id", F.transform("reduced", lambda x: F.round(x, 6)).alias("reduced"), ratio.alias("explained"))


@query(
    "pca_full_rotation",
    """
    WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    mu AS (SELECT i, avg(v) AS m FROM x GROUP BY i)
    SELECT vec_id, round(sum((v - m) * (v - m)), 6) AS squared_length FROM x JOIN mu USING (i) GROUP BY vec_id
    """,
)
def pca_full_rotation(spark, folder):
    """All components kept: a rotation, so centred lengths do not change."""
    rows = table(spark, folder, "embeddings")
    width = len(rows.select("embedding").first()[0])
    turned = fit_projection(rows, "embedding", width).transform(rows, "embedding", "turned")
    squared = F.aggregate("turned", F.lit(0.0), lambda total, x: total + x * x)
    return turned.select("vec_id", F.round(squared, 6).alias("squared_length"))


@query(
    "pca_two_to_one",
    """
    WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p),
    e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS first FROM m),
    u AS (SELECT *, CASE WHEN b = 0 THEN CASE WHEN a >= c THEN 1 ELSE 0 END ELSE b END AS ux,
                 CASE WHEN b = 0 THEN CASE WHEN a >= c THEN 0 ELSE 1 END ELSE first - a END AS uy FROM e),
    n AS (SELECT *, sqrt(ux * ux + uy * uy) * CASE WHEN CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END < 0 THEN -1 ELSE 1 END AS norm FROM u)
    SELECT vec_id, round(((x - mx) * ux + (y - my) * uy) / norm, 6) AS projected, round(first / (a + c), 6) AS explained FROM p, n
    """,
)
def pca_two_to_one(spark, folder):
    """Two dimensions projected to one, where axis and explained share have a closed form."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("pair"))
    fitted = fit_projection(rows, "pair", 1)
    projected = fitted.transform(rows, "pair", "reduced").select("vec_id", F.round(F.get("reduced", F.lit(0)), 6).alias("projected"))
    return projected.withColumn("explained", F.lit(round(fitted.explained_variance_ratio[0], 6)))


# --- documents and text vectors -----------------------------------------------------------------

_DOCUMENT = """concat_ws(' | ', CASE WHEN p_partkey % 3 <> 0 THEN p_name END, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, p_type,
    CASE WHEN p_partkey % 2 = 0 OR p_partkey % 4 = 1 THEN concat('Tags: ', concat_ws(', ',
        CASE WHEN p_partkey % 2 = 0 THEN 't2' END, CASE WHEN p_partkey % 4 = 1 THEN 't4' END)) END)"""


@query("build_document", f"SELECT p_partkey AS track_id, {_DOCUMENT} AS document FROM part")
def documents_of_parts(spark, folder):
    key = F.col("p_partkey")
    fields = [F.when(key % 3 != 0, F.col("p_name")), F.when(key % 5 != 0, F.col("p_brand")), F.col("p_type")]
    tags = [F.when(key % 2 == 0, F.lit("t2")), F.when(key % 4 == 1, F.lit("t4"))]
    return table(spark, folder, "part").select(key.alias("track_id"), build_document(fields, tags).alias("document"))


_MOODS = "(q LIKE '%triste%' OR q LIKE '%alegre%' OR q LIKE '%melancólico%' OR q LIKE '%energético%' OR q LIKE '%relajado%' OR q LIKE '%romántico%')"
_GENRES = "(q LIKE '%pop%' OR q LIKE '%rock%' OR q LIKE '%jazz%' OR q LIKE '%country%' OR q LIKE '%hip hop%' OR q LIKE '%electronic%')"


@query(
    "expand_query",
    rf"""
    WITH asked AS (
        SELECT 'c' || conv_id || '-' || turn AS query_id, text FROM conversations
        UNION ALL SELECT 'p' || p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Triste ' || p_brand WHEN 1 THEN 'popular' WHEN 2 THEN p_name
            WHEN 3 THEN 'rock ' || p_name WHEN 4 THEN ' alegre  rock ' ELSE p_name || ' JAZZ' END FROM part),
    lowered AS (SELECT *, lower(text) AS q, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 2 AS short FROM asked)
    SELECT query_id, CASE WHEN short AND {_MOODS} THEN 'canciones con mood ' || text
                          WHEN short AND {_GENRES} THEN 'música de género ' || text ELSE text END AS expanded
    FROM lowered
    """,
)
def expanded_queries(spark, folder):
    asked = table(spark, folder, "conversations").selectExpr("concat('c', conv_id, '-', turn) AS query_id", "text")
    constructed = table(spark, folder, "part").selectExpr(
        "concat('p', p_partkey) AS query_id",
        """CASE p_partkey % 6 WHEN 0 THEN concat('Triste ', p_brand) WHEN 1 THEN 'popular' WHEN 2 THEN p_name
           WHEN 3 THEN concat('rock ', p_name) WHEN 4 THEN ' alegre  rock ' ELSE concat(p_name, ' JAZZ') END AS text""",
    )
    return asked.unionByName(constructed).select("query_id", expand_query(F.col("text")).alias("expanded"))


# Spark ML hashes terms with MurmurHash3 (32 bit, seed 42). The same arithmetic over ASCII tokens,
# once per distinct token: four-byte blocks, the tail, the final mix, and the signed remainder.
_M32 = "4294967295::UBIGINT"


def _times(x: str, factor: int) -> str:
    return f"((({x}) * {factor}::UBIGINT) & {_M32})"


def _turn(x: str, bits: int) -> str:
    return f"(((({x}) << {bits}) | (({x}) >> {32 - bits})) & {_M32})"


# y: the UTF-8 bytes of a word.
_BYTES = "list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::UBIGINT)"
_BLOCK = " + ".join(f"y[4 * i + {b + 1}] * {256**b}::UBIGINT" for b in range(4))
_TAIL = " + ".join(
    f"CASE WHEN len(y) % 4 > {b} THEN y[4 * (len(y) // 4) + {b + 1}] * {256**b}::UBIGINT ELSE 0::UBIGINT END"
    for b in range(3)
)


def tfidf_ctes(texts: str, dimension: int) -> str:
    """CTEs up to ``buckets(w, b)`` and ``tf(id, b, n)`` for a relation ``texts(id, text)``."""
    return rf"""
    words AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM {texts}),
    h0 AS (SELECT w, {_BYTES} AS y FROM (SELECT DISTINCT w FROM words)),
    h1 AS (SELECT w, len(y) AS size, list_transform(range(0, len(y) // 4), lambda i: {_BLOCK}) AS bs, {_TAIL} AS tail FROM h0),
    h2 AS (SELECT w, size, list_transform(list_transform(list_transform(bs, lambda x: {_times('x', 3432918353)}), lambda x: {_turn('x', 15)}),
                                    lambda x: {_times('x', 461845907)}) AS bs, {_times('tail', 3432918353)} AS tail FROM h1),
    h3 AS (SELECT w, size, list_reduce(bs, lambda h, x: ({_turn('xor(h, x)', 13)} * 5::UBIGINT + 3864292196::UBIGINT) & {_M32}, 42::UBIGINT) AS h,
                  {_times(_turn('tail', 15), 461845907)} AS tail FROM h2),
    h4 AS (SELECT w, xor(xor(h, tail), size::UBIGINT) AS h FROM h3),
    h5 AS (SELECT w, {_times('xor(h, h >> 16)', 2246822507)} AS h FROM h4),
    h6 AS (SELECT w, {_times('xor(h, h >> 13)', 3266489909)} AS h FROM h5),
    h7 AS (SELECT w, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM h6),
    buckets AS (SELECT w, CAST((((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % {dimension}) + {dimension}) % {dimension} AS INT) AS b FROM h7),
    tf AS (SELECT id, b, count(*) AS n FROM words JOIN buckets USING (w) GROUP BY id, b)
    """


_WEIGHTS = """
    size AS (SELECT count(*) AS m FROM docs WHERE text IS NOT NULL),
    idf AS (SELECT b, ln((m + 1) / CAST(count(*) + 1 AS DOUBLE)) AS f FROM tf, size WHERE id LIKE 'd%' GROUP BY b, m),
    weighted AS (SELECT id, b, n * coalesce(f, (SELECT ln(m + 1.0::DOUBLE) FROM size)) AS x FROM tf LEFT JOIN idf USING (b)),
    lengths AS (SELECT id, sqrt(sum(x * x)) AS norm FROM weighted GROUP BY id),
    unit AS (SELECT id, b, x / norm AS x FROM weighted JOIN lengths USING (id) WHERE norm > 0)
"""


@query(
    "text_vectors",
    f"""
    WITH docs AS (SELECT 'd' || doc_id AS id, text FROM documents), {tfidf_ctes('docs', 768)}, {_WEIGHTS}
    SELECT CAST(substr(id, 2) AS BIGINT) AS doc_id, b AS position, round(x, 6) AS weight FROM unit WHERE abs(x) > 0
    """,
)
def text_vectors(spark, folder):
    """Non-zero entries of every document's 768-d text vector."""
    documents = texts(spark, folder).select("doc_id", "text")
    vectors = fit_hashed_text(documents, "text").transform(documents, "text")
    # Only the entries that hold something become rows.
    numbered = F.transform("text_embedding", lambda x, i: F.struct(i.alias("position"), F.round(x, 6).alias("weight"), x.alias("x")))
    entries = vectors.select("doc_id", F.inline(F.filter(numbered, lambda entry: entry["x"] != 0)))
    return entries.drop("x")


@query(
    "embed_with_model",
    """
    SELECT doc_id, length(text) % 7 AS first, length(text) % 11 AS second, 2 AS embedding_dimension FROM documents
    """,
)
def embed_with_model(spark, folder):
    """A user-supplied model called on batches of 25 texts."""

    def embed(texts):
        return [[len(t) % 7, len(t) % 11] for t in texts]

    embedded = embed_with(texts(spark, folder).select("doc_id", "text"), "text", embed, dimension=2)
    first, second = (F.get("text_embedding", F.lit(i)).cast("long") for i in (0, 1))
    return embedded.select("doc_id", first.alias("first"), second.alias("second"), "embedding_dimension")


# --- hybrid vectors and pairs -------------------------------------------------------------------

_NORM = "sqrt(list_inner_product({v}, {v}))"


@query(
    "hybrid_vector",
    f"""
    WITH p AS (SELECT vec_id, CAST(embedding[1:48] AS DOUBLE[]) AS t, CASE WHEN vec_id % 6 = 0 THEN list_transform(embedding[49:64], lambda x: 0.0::DOUBLE) ELSE CAST(embedding[49:64] AS DOUBLE[]) END AS f FROM embeddings),
    n AS (SELECT vec_id, t, f, {_NORM.format(v='t')} AS tn, {_NORM.format(v='f')} AS fn FROM p),
    c AS (SELECT vec_id, list_concat(list_transform(t, lambda x: x / CASE WHEN tn = 0 THEN 1 ELSE tn END * 0.7),
                                     list_transform(f, lambda x: x / CASE WHEN fn = 0 THEN 1 ELSE fn END * 0.3)) AS v FROM n),
    k AS (SELECT vec_id, v, {_NORM.format(v='v')} AS vn FROM c)
    SELECT vec_id, len(v) AS combined_dimension, array_to_string(list_transform(v, lambda x: CAST(round(x / vn * 1000000) + 0.0 AS BIGINT)), ',') AS combined FROM k
    """,
)
def hybrid_vectors(spark, folder):
    whole = as_vector(F.col("embedding"))
    zero = F.transform(F.slice(whole, 49, 16), lambda x: F.lit(0.0))
    parts = table(spark, folder, "embeddings").select(
        "vec_id",
        F.slice(whole, 1, 48).alias("t"),
        F.when(F.col("vec_id") % 6 == 0, zero).otherwise(F.slice(whole, 49, 16)).alias("f"),
    )
    combined = parts.select("vec_id", hybrid_vector(F.col("t"), F.col("f")).alias("v"))
    micro = F.transform("v", lambda x: F.round(x * 1000000).cast("long").cast("string"))
    return combined.select("vec_id", F.size("v").alias("combined_dimension"), F.array_join(micro, ",").alias("combined"))


@query(
    "unit_vectors",
    f"""
    WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, {_NORM.format(v='e')} AS norm FROM p)
    SELECT vec_id, array_to_string(list_transform(e, lambda x: CAST(round(x / norm * 1000000) AS BIGINT)), ',') AS unit FROM n
    """,
)
def unit_vectors(spark, folder):
    unit = l2_normalize(as_vector(F.col("embedding")))
    micro = F.transform(unit, lambda x: F.round(x * 1000000).cast("long").cast("string"))
    return table(spark, folder, "embeddings").select("vec_id", F.array_join(micro, ",").alias("unit"))


@query(
    "pair_similarity",
    """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(1 / (1 + list_distance(a.e, b.e)), 6) AS euclidean,
           round(list_inner_product(a.e, b.e), 6) AS dot
    FROM v a JOIN v b ON b.vec_id = a.vec_id + 1
    """,
)
def pair_similarity(spark, folder):
    left = table(spark, folder, "embeddings").select("vec_id", as_vector(F.col("embedding")).alias("a"))
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    pairs = left.join(right, "vec_id")
    return pairs.select(
        "vec_id", *[F.round(similarity(F.col("a"), F.col("b"), m), 6).alias(m) for m in ("cosine", "euclidean", "dot")]
    )


@query(
    "vector_coverage",
    """
    SELECT count(*) AS rows, count(CASE WHEN vec_id % 4 <> 0 THEN 1 END) AS text_embedding_count, 64 AS text_embedding_dimension,
           count(*) AS feature_embedding_count, 64 AS feature_embedding_dimension FROM embeddings
    """,
)
def coverage(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("text_embedding"),
        F.col("embedding").alias("feature_embedding"),
    )
    return vector_coverage(rows)


_CHAIN_FEATURES = {
    "popularity": "popularity",
    "duration_ms": "duration_ms",
    "explicit": "CAST(explicit AS INT)",
    "popularity_normalized": "popularity / 100",
    "is_popular": "CAST(popularity >= 60 AS INT)",
    "duration_seconds": "duration_ms / 1000",
    "is_short_track": "CAST(duration_ms / 60000 < 3 AS INT)",
    "is_long_track": "CAST(duration_ms / 60000 > 5 AS INT)",
    "release_year": "year(CAST(release_date AS DATE))",
    "track_age_years": "2024 - year(CAST(release_date AS DATE))",
    "is_recent_release": "CAST(2024 - year(CAST(release_date AS DATE)) < 1 AS INT)",
}


def chain_vectors(spark, folder):
    """Features and all three vectors of the catalogue."""
    return build_vectors(build_features(catalogue(spark, folder), as_of_year=2024))


CHAIN_CTES = f"""
    x AS (SELECT track_id, track_name, artist_name, album_name, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _CHAIN_FEATURES.items())}
          FROM ({select_sql(CATALOGUE)})),
    st AS (SELECT {', '.join(f'avg({n}) AS {n}_m, stddev_pop({n}) AS {n}_s' for n in _CHAIN_FEATURES)} FROM x),
    fv AS (SELECT track_id, track_name, artist_name, album_name,
                  [{', '.join(f'CASE WHEN {n}_s = 0 THEN 0.0 ELSE ({n} - {n}_m) / {n}_s END' for n in _CHAIN_FEATURES)}] AS v FROM x, st)
"""


@query(
    "feature_vectors",
    f"""
    WITH {CHAIN_CTES}
    SELECT track_id, len(v) AS feature_dimension, {', '.join(f'round(v[{i + 1}], 6) AS {n}' for i, n in enumerate(_CHAIN_FEATURES))} FROM fv
    """,
)
def chain_feature_vectors(spark, folder):
    vectors = feature_vectors(build_features(catalogue(spark, folder), as_of_year=2024))
    named = [F.round(F.get("feature_embedding", F.lit(i)), 6).alias(n) for i, n in enumerate(_CHAIN_FEATURES)]
    return vectors.select("track_id", "feature_dimension", *named)
