"""Lookup, search, paging, neighbours, recommendations, semantic search."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.bindings.registry import query
from trackweave.bindings.stand_ins import CATALOGUE, catalogue, select_sql, table, texts, vectors
from trackweave.bindings.vector_queries import _WEIGHTS, CHAIN_CTES, tfidf_ctes
from trackweave.functions.numeric import percentage
from trackweave.operators import lookup
from trackweave.operators.fuzzy import match_names
from trackweave.operators.neighbours import nearest
from trackweave.operators.ranking import page, page_number, with_total
from trackweave.operators.scaling import feature_vectors
from trackweave.operators.text_index import build_text_index
from trackweave.operators.text_vectors import fit_hashed_text
from trackweave.operators.vector_index import build_index
from trackweave.plans import recommend
from trackweave.plans.transform import build_features
from trackweave.session import materialize, shared_dir
from trackweave.sources import tables
from trackweave.sources.cache import TableCache
from trackweave.sources.ordered import ordered_copy

_CAT = f"cat AS ({select_sql(CATALOGUE)})"
_SHOWN = ("track_id", "track_name", "artist_name", "album_name")



def _new_folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- lookup -------------------------------------------------------------------------------------


@query("find_by_id", f"WITH {_CAT} SELECT track_id, track_name, artist_name, album_name FROM cat WHERE track_id = 42")
def find_by_id(spark, folder):
    return lookup.find_by_id(catalogue(spark, folder), 42).select(*_SHOWN)


_ASKED = {
    "query_id": "p_partkey",
    "track_id": "CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE -1 END",
    "track_name": "CASE WHEN p_partkey % 11 = 0 THEN concat(p_name, ' (live)') ELSE upper(p_name) END",
    "artist_name": "CASE WHEN p_partkey % 3 = 1 THEN 'nobody' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END",
}


_RESOLVED = f"""
    {_CAT}, asked AS ({select_sql(_ASKED)}),
    by_name AS (SELECT lower(track_name) AS n, count(*) AS c, min(track_id) AS first FROM cat GROUP BY 1),
    by_artist AS (SELECT lower(track_name) AS n, lower(artist_name) AS a, min(track_id) AS first FROM cat GROUP BY 1, 2),
    hit AS (SELECT q.query_id, c.track_id AS known, CASE WHEN b.c > 1 AND q.artist_name IS NOT NULL THEN d.first ELSE b.first END AS named,
                   lower(q.track_name) AS n, coalesce(lower(q.artist_name), '') AS a
            FROM asked q LEFT JOIN cat c ON c.track_id = q.track_id LEFT JOIN by_name b ON b.n = lower(q.track_name)
            LEFT JOIN by_artist d ON d.n = lower(q.track_name) AND d.a = lower(q.artist_name)),
    exact AS (SELECT query_id, coalesce(known, named) AS matched_id,
                     CASE WHEN known IS NOT NULL THEN 'id' WHEN named IS NOT NULL THEN 'name' END AS method, n, a FROM hit)
"""

# The longest common block of the open parts, earliest first: its length in millions, less a thousand times its place in
# the query and its place in the candidate.
_BLOCK = """list_max(list_transform(range({alo}, {ahi}), lambda i: list_max(list_transform(range({blo}, {bhi}), lambda j:
    len(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), lambda k: substr(x, i + 1, k) = substr(y, j + 1, k))) * 1000000 - i * 1000 - j))))"""
_LENGTH = "(best + 999999) // 1000000"

# The Ratcliff-Obershelp ratio by its definition: what is left and right of the longest block is matched likewise.
# ``wanted(n, a)`` are the queries, ``fuzzy(n, a, id, score)`` the best row for each.
_FUZZY = f"""
    items AS (SELECT lower(track_name) AS n, lower(artist_name) AS a, min(track_id) AS id FROM cat GROUP BY 1, 2),
    pairs AS (SELECT q.n AS x, c.n AS y FROM (SELECT DISTINCT n FROM wanted) q, (SELECT DISTINCT n FROM items) c
              UNION SELECT q.a, c.a FROM (SELECT DISTINCT a FROM wanted) q, (SELECT DISTINCT a FROM items) c),
    work AS (
        SELECT x, y, 0::BIGINT AS alo, length(x) AS ahi, 0::BIGINT AS blo, length(y) AS bhi,
               {_BLOCK.format(alo=0, ahi='length(x)', blo=0, bhi='length(y)')} AS best FROM pairs WHERE x <> '' AND y <> ''
        UNION ALL
        SELECT x, y, part.alo, part.ahi, part.blo, part.bhi, {_BLOCK.format(alo='part.alo', ahi='part.ahi', blo='part.blo', bhi='part.bhi')}
        FROM (SELECT x, y, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j}}, {{'alo': i + k, 'ahi': ahi, 'blo': j + k, 'bhi': bhi}}]) AS part
              FROM (SELECT *, {_LENGTH} AS k, ({_LENGTH} * 1000000 - best) // 1000 AS i, ({_LENGTH} * 1000000 - best) % 1000 AS j FROM work)
              WHERE k > 0)
        WHERE part.alo < part.ahi AND part.blo < part.bhi),
    ratio AS (SELECT x, y, 2.0::DOUBLE * sum({_LENGTH}) / (length(x) + length(y)) AS r FROM work GROUP BY x, y),
    scored AS (SELECT w.n, w.a, c.id, CASE WHEN w.a = '' THEN n.r ELSE n.r * 0.7::DOUBLE + coalesce(a.r, 0) * 0.3::DOUBLE END AS score
               FROM (SELECT DISTINCT n, a FROM wanted) w JOIN ratio n ON n.x = w.n JOIN items c ON c.n = n.y
               LEFT JOIN ratio a ON a.x = w.a AND a.y = c.a),
    fuzzy AS (SELECT n, a, id, score FROM scored WHERE score >= 0.8
              QUALIFY row_number() OVER (PARTITION BY n, a ORDER BY score DESC, id) = 1)
"""


@query("resolve_exact", f"WITH {_RESOLVED} SELECT query_id, CAST(matched_id AS DOUBLE) AS matched_id, method FROM exact")
def resolve_exact(spark, folder):
    asked = table(spark, folder, "part").select(*[F.expr(text).alias(name) for name, text in _ASKED.items()])
    found = lookup.resolve_exact(asked, catalogue(spark, folder))
    return found.select("query_id", F.col("matched_id").cast("double").alias("matched_id"), "method")


@query(
    "fuzzy_match",
    f"""
    WITH RECURSIVE {_CAT},
    asked AS (SELECT lower(regexp_replace(track_name, '.$', '')) AS n, lower(artist_name) AS a, min(track_id) AS query_id
              FROM cat GROUP BY track_name, artist_name),
    wanted AS (SELECT n, a FROM asked), {_FUZZY}
    SELECT query_id, id AS matched_id, round(score, 6) AS score FROM asked JOIN fuzzy USING (n, a)
    """,
)
def fuzzy_match(spark, folder):
    """Every distinct name and artist of the catalogue, misspelt by its last letter."""
    parts = catalogue(spark, folder)
    asked = parts.groupBy("track_name", "artist_name").agg(F.min("track_id").alias("query_id"))
    misspelt = asked.withColumn("track_name", F.regexp_replace("track_name", ".$", ""))
    return match_names(misspelt, parts).withColumn("score", F.round("score", 6))


@query(
    "resolve_with_fuzzy",
    f"""
    WITH RECURSIVE {_RESOLVED}, wanted AS (SELECT n, a FROM exact WHERE matched_id IS NULL), {_FUZZY}
    SELECT query_id, matched_id, method FROM exact WHERE matched_id IS NOT NULL
    UNION ALL
    SELECT query_id, id, 'fuzzy' FROM exact JOIN fuzzy USING (n, a) WHERE matched_id IS NULL
    """,
)
def resolve_with_fuzzy(spark, folder):
    """Ids, exact names and misspelt names in one go."""
    asked = table(spark, folder, "part").select(*[F.expr(text).alias(name) for name, text in _ASKED.items()])
    return recommend.resolve(asked, catalogue(spark, folder))


@query(
    "search_name_or_artist",
    f"""
    WITH {_CAT} SELECT track_id, track_name, artist_name, album_name FROM cat
    WHERE contains(lower(track_name), 'widget') OR contains(lower(artist_name), 'widget') ORDER BY track_id LIMIT 10
    """,
)
def search_name_or_artist(spark, folder):
    return lookup.search(catalogue(spark, folder), "Widget").select(*_SHOWN)


@query(
    "search_regex",
    f"""
    WITH {_CAT} SELECT track_id, track_name, artist_name, album_name FROM cat
    WHERE regexp_matches(lower(track_name), '^re.*t$') OR regexp_matches(lower(artist_name), '^re.*t$') ORDER BY track_id LIMIT 50
    """,
)
def search_regex(spark, folder):
    return lookup.search(catalogue(spark, folder), "^Re.*t$", limit=50, regex=True).select(*_SHOWN)


@query(
    "autocomplete",
    f"""
    WITH {_CAT}
    SELECT track_id, track_name, artist_name, album_name FROM cat
    WHERE contains(lower(track_name), 'ri') OR contains(lower(artist_name), 'ri') ORDER BY track_id LIMIT 5
    """,
)
def autocomplete(spark, folder):
    return lookup.autocomplete(catalogue(spark, folder), " Ri ").select(*_SHOWN)


@query(
    "autocomplete_indexed",
    f"""
    WITH {_CAT}, typed AS (SELECT * FROM (VALUES ('r'), ('ri'), ('rin'), ('ring'), ('d#2'), ('green w')) t(typed)),
    hits AS (
        SELECT typed, track_id, track_name, artist_name, row_number() OVER (PARTITION BY typed ORDER BY track_id) AS place
        FROM cat JOIN typed ON length(typed) > 1 AND (contains(lower(track_name), typed) OR contains(lower(artist_name), typed))
    )
    SELECT * FROM hits WHERE place <= 5
    """,
)
def autocomplete_indexed(spark, folder):
    """Keystrokes of several searches, answered from posting lists."""
    rows = catalogue(spark, folder)
    index = build_text_index(rows, _new_folder(spark, "text-index"))
    place = F.row_number().over(Window.orderBy("track_id")).alias("place")
    found = [
        lookup.autocomplete(rows, typed, index=index).select(F.lit(typed.strip().lower()).alias("typed"), *_SHOWN[:3], place)
        for typed in ("r", " Ri ", "rin", "ring", "D#2", "green w")
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "list_page",
    "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
)
def list_page(spark, folder):
    orders = table(spark, folder, "orders")
    return with_total(page(orders, "o_orderkey", offset=100, limit=50), orders).select("o_orderkey", "o_custkey", "total")


@query(
    "deep_page",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 12000",
)
def deep_page(spark, folder):
    return page(table(spark, folder, "orders"), "o_orderkey", offset=12_000, limit=100).select("o_orderkey", "o_custkey")


@query(
    "deep_page_by_text",
    "SELECT 'order ' || o_orderkey AS order_id, o_custkey FROM orders ORDER BY order_id LIMIT 100 OFFSET 12000",
)
def deep_page_by_text(spark, folder):
    """The same by a string id, whatever prefix the ids share: from a copy in their order."""
    orders = table(spark, folder, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("order_id"), "o_custkey")
    return ordered_copy(orders, _new_folder(spark, "ordered"), "order_id").page(12_000, 100)


# --- neighbours ---------------------------------------------------------------------------------

_VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SCORES = {
    "cosine": "list_cosine_similarity(q.e, c.e)",
    "euclidean": "1 / (1 + list_distance(q.e, c.e))",
    "dot": "list_inner_product(q.e, c.e)",
}


def _ranked_sql(metric: str, where: str = "true") -> str:
    return f"""
    {_VECTORS},
    s AS (SELECT q.vec_id AS query_id, q.label AS own, c.vec_id AS track_id, c.label, {_SCORES[metric]} AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, track_id) AS rank FROM s)
    """


@query(
    "recommend_one",
    f"""
    WITH {_ranked_sql('cosine', 'q.vec_id = 0')}
    SELECT 0 AS query_id, rank, track_id, 'vector ' || track_id AS track_name, CAST(label AS VARCHAR) AS artist_name,
           'embeddings' AS album_name, round(score, 4) AS similarity_score FROM r WHERE rank <= 10
    """,
)
def recommend_one(spark, folder):
    """Ten nearest neighbours of one vector, itself left out."""
    return recommend.recommend_one(vectors(spark, folder), track_id=0)


@query(
    "recommend_other_artists",
    f"""
    WITH {_ranked_sql('cosine')},
    kept AS (SELECT * FROM r WHERE rank <= 11 AND label <> own AND score >= 0.2),
    again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM kept)
    SELECT query_id, place AS rank, track_id, CAST(label AS VARCHAR) AS artist_name, round(score, 4) AS similarity_score FROM again WHERE place <= 10
    """,
)
def recommend_other_artists(spark, folder):
    """Every vector as a query; neighbours of the same label drop out after the cut, without refill."""
    rows = vectors(spark, folder)
    found = recommend.recommend_batch(rows, rows, exclude_same_artist=True, min_similarity=0.2)
    return found.select("query_id", "rank", "track_id", "artist_name", "similarity_score")


@query(
    "recommend_refilled",
    f"""
    WITH {_ranked_sql('cosine', 'q.label <> c.label')}
    SELECT query_id, rank, track_id, CAST(label AS VARCHAR) AS artist_name, round(score, 4) AS similarity_score FROM r WHERE rank <= 10
    """,
)
def recommend_refilled(spark, folder):
    rows = vectors(spark, folder)
    found = recommend.recommend_batch(rows, rows, exclude_same_artist=True, min_similarity=-1.0, refill=True)
    return found.select("query_id", "rank", "track_id", "artist_name", "similarity_score")


@query(
    "recommend_cached",
    f"""
    WITH {_ranked_sql('dot', 'q.vec_id IN (1, 2)')}
    SELECT query_id, rank, track_id, round(score, 4) AS similarity_score FROM r WHERE rank <= 5
    """,
)
def recommend_cached(spark, folder):
    """Two requests on a catalogue kept in memory."""
    rows = recommend.cached(vectors(spark, folder))
    found = [
        recommend.recommend_one(rows, track_id=i, k=5, metric="dot", min_similarity=-1e9).withColumn("query_id", F.lit(i))
        for i in (1, 2)
    ]
    return found[0].unionByName(found[1]).select("query_id", "rank", "track_id", "similarity_score")


_REQUEST = {
    "k": "CAST(p_size - 2 AS INT)",
    "kind": "CASE WHEN p_partkey % 7 = 0 THEN 'lyrics' WHEN p_partkey % 7 = 1 THEN 'text' ELSE 'combined' END",
    "id": "CASE WHEN p_partkey % 3 = 0 THEN p_partkey END",
    "asked_name": "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 <> 1 THEN p_name END",
}


@query(
    "cache_follows_table",
    """
    SELECT o_orderstatus, count(*) FILTER (o_orderkey % 2 = 0) AS first_rows, count(*) FILTER (o_orderkey % 2 = 0) AS again_rows,
        count(*) AS later_rows
    FROM orders GROUP BY ALL
    """,
)
def cache_follows_table(spark, folder):
    """A table read through the cache, read again, and read after an append."""
    orders, place = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), _new_folder(spark, "cached-orders")
    cache = TableCache(spark)

    def counted(name):
        rows = cache.get(place).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias(name))
        # Stored, since the cache drops what it has read when the table grows.
        return materialize(rows)

    tables.append_table(orders.filter("o_orderkey % 2 = 0"), place)
    first, again = counted("first_rows"), counted("again_rows")
    tables.append_table(orders.filter("o_orderkey % 2 <> 0"), place)
    joined = counted("later_rows").join(first, "o_orderstatus").join(again, "o_orderstatus")
    cache.clear()
    return joined.select("o_orderstatus", "first_rows", "again_rows", "later_rows")


@query(
    "request_checks",
    f"""
    SELECT p_partkey, CASE WHEN id IS NULL AND coalesce(asked_name, '') = '' THEN 'a track id or a track name is needed'
        WHEN kind = 'lyrics' THEN 'unknown embedding_type' WHEN k NOT BETWEEN 1 AND 50 THEN 'k must lie between 1 and 50' END AS problem
    FROM (SELECT p_partkey, {', '.join(f'{text} AS {name}' for name, text in _REQUEST.items())} FROM part)
    """,
)
def request_checks(spark, folder):
    """What is wrong with each of a table of requests."""
    asked = table(spark, folder, "part").select("p_partkey", *[F.expr(text).alias(name) for name, text in _REQUEST.items()])
    problem = recommend.request_problem(F.col("k"), F.col("kind"), F.col("id"), F.col("asked_name"))
    return asked.select("p_partkey", problem.alias("problem"))


def _neighbours(metric: str):
    def run(spark, folder):
        rows = table(spark, folder, "embeddings")
        asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        items = rows.select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("vector"))
        found = nearest(asked, items, 10, metric, exclude=[("query_id", "track_id")])
        return found.select("query_id", "rank", "track_id", F.round("score", 4).alias("similarity_score"))

    return run


for _metric in _SCORES:
    query(
        f"neighbours_{_metric}",
        f"WITH {_ranked_sql(_metric)} SELECT query_id, rank, track_id, round(score, 4) AS similarity_score FROM r WHERE rank <= 10",
    )(_neighbours(_metric))


@query("ann_neighbours")
def ann_neighbours(spark, folder):
    """Ten near neighbours by cosine from a stored index, for ids that 100 divides; the tests hold it against all rows."""
    rows = vectors(spark, folder).withColumnRenamed("combined_embedding", "vector")
    index = build_index(rows, _new_folder(spark, "vector-index"), carry=["artist_name"])
    asked = rows.filter(F.col("track_id") % 100 == 0).select(F.col("track_id").alias("query_id"), "vector")
    found = index.nearest(asked, 10, carry=["artist_name"], exclude=[("query_id", "track_id")])
    return found.select("query_id", "rank", "track_id", "artist_name", F.round("score", 4).alias("similarity_score"))


@query(
    "result_pages",
    f"""
    WITH {_ranked_sql('cosine')}
    SELECT query_id, rank, track_id, CAST(ceil(rank / 6.0) AS INT) AS page, CAST(floor(round(score, 4) * 100 + 0.5) AS INT) AS per_cent FROM r WHERE rank <= 20
    """,
)
def result_pages(spark, folder):
    """Twenty results per vector, six to a page, scores as whole per cent."""
    rows = vectors(spark, folder)
    found = recommend.recommend_batch(rows, rows, k=20, min_similarity=-1.0)
    return found.select(
        "query_id", "rank", "track_id", page_number(F.col("rank")).alias("page"),
        percentage(F.col("similarity_score")).alias("per_cent"),
    )


@query(
    "recommend_wide",
    f"""
    WITH {_ranked_sql('cosine')}
    SELECT r.query_id, r.rank, r.track_id, round(r.score, 4) AS similarity_score, e.label AS popularity
    FROM r JOIN embeddings e ON e.vec_id = r.track_id WHERE rank <= 3
    """,
)
def recommend_wide(spark, folder):
    """Results widened by a column of another table."""
    rows = vectors(spark, folder)
    features = table(spark, folder, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("label").alias("popularity"))
    found = recommend.recommend_batch(rows, rows, k=3, min_similarity=-1.0)
    return recommend.with_features(found, features, ["popularity"]).select(
        "query_id", "rank", "track_id", "similarity_score", "popularity"
    )


@query(
    "recommend_by_name",
    f"""
    WITH {CHAIN_CTES},
    target AS (SELECT min(track_id) AS id FROM fv WHERE lower(track_name) = 'red widget'),
    s AS (SELECT c.track_id, list_cosine_similarity(q.v, c.v) AS score FROM target t JOIN fv q ON q.track_id = t.id JOIN fv c ON c.track_id <> t.id),
    r AS (SELECT *, row_number() OVER (ORDER BY round(score, 10) DESC, track_id) AS rank FROM s)
    SELECT rank, round(score, 4) AS similarity_score FROM r WHERE rank <= 20
    """,
)
def recommend_by_name(spark, folder):
    """Name to track to feature vector to neighbours."""
    featured = materialize(feature_vectors(build_features(catalogue(spark, folder), as_of_year=2024)))
    found = recommend.recommend_one(featured, track_name="Red Widget", k=20, embedding_type="feature")
    return found.select("rank", "similarity_score")


@query(
    "recommend_by_features",
    f"""
    WITH {CHAIN_CTES},
    s AS (SELECT q.track_id AS query_id, c.track_id, c.track_name, c.artist_name, list_cosine_similarity(q.v, c.v) AS score
          FROM fv q JOIN fv c ON q.track_id <> c.track_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, track_id) AS rank FROM s)
    SELECT query_id, rank, round(score, 4) AS similarity_score FROM r WHERE rank <= 10
    """,
)
def recommend_by_features(spark, folder):
    """Catalogue to features to scaled vectors to neighbours of every track."""
    featured = materialize(feature_vectors(build_features(catalogue(spark, folder), as_of_year=2024)))
    found = recommend.recommend_batch(featured, featured, embedding_type="feature", min_similarity=-1.0)
    return found.select("query_id", "rank", "similarity_score")


# --- semantic search ----------------------------------------------------------------------------


@query(
    "semantic_search",
    f"""
    WITH docs AS (SELECT 'd' || doc_id AS id, text FROM documents), texts AS (SELECT * FROM docs UNION ALL SELECT 'q' || item_id, text FROM benchmark),
    {tfidf_ctes('texts', 768)}, {_WEIGHTS},
    s AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS score FROM unit q JOIN unit d USING (b)
          WHERE q.id LIKE 'q%' AND d.id LIKE 'd%' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, CAST(substr(doc_id, 2) AS BIGINT)) AS rank FROM s)
    SELECT CAST(substr(query_id, 2) AS BIGINT) AS query_id, rank, CAST(substr(doc_id, 2) AS BIGINT) AS track_id, round(score, 4) AS similarity_score
    FROM r WHERE rank <= 10 AND score >= 0.3
    """,
)
def semantic_search(spark, folder):
    """Every benchmark text as a query over all documents."""
    documents = texts(spark, folder).select(F.col("doc_id").alias("track_id"), "text")
    model = fit_hashed_text(documents, "text")
    items = model.transform(documents, "text").select("track_id", "text_embedding")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return recommend.semantic_search(items, asked, model, display=())
