"""Search and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions.text import sparse_terms
from vecloom.operators.embed import HashEmbedder, embed_texts
from vecloom.operators.filters import apply_filter
from vecloom.operators.pruned import build_dense_index, build_sparse_index, pruned_dense_search, pruned_sparse_search
from vecloom.operators.service import Served, search_service
from vecloom.operators.search import (
    attach_points,
    dense_search,
    hybrid_search,
    resolve_mode,
    search_requests,
    sparse_search,
    term_statistics,
    text_queries,
)
from vecloom.operators.validate import check, query_rules
from vecloom.plans import bindings as b
from vecloom.plans.registry import query
from vecloom.session import scratch_path, written
from vecloom.sources import tables
from vecloom.sources.tables import PointTable
from vecloom.spec import CollectionSpec

COSINE_SQL = (
    "round(list_inner_product(v, embedding::DOUBLE[]) / (sqrt(list_inner_product(v, v)) *"
    " sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6)"
)
DENSE_SCORES_SQL = f"d AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id, {COSINE_SQL} AS score FROM q, embeddings)"


@query("dense_topk", f"WITH {b.QUERIES_SQL}, {DENSE_SCORES_SQL} {b.top_sql('d', 10)}")
def dense_topk(spark, sf_dir):
    return dense_search(b.requests(spark, sf_dir), b.embedded(spark, sf_dir), 10)


@query("pruned_dense_topk", f"WITH {b.QUERIES_SQL}, {DENSE_SCORES_SQL} {b.top_sql('d', 10)}")
def pruned_dense_topk(spark, sf_dir):
    """The same hits from an index of pivots, whose blocks are read only where they may hold one."""
    index = build_dense_index(b.embedded(spark, sf_dir), scratch_path(spark, "pivots"), vector_size=64, pivots=16)
    return pruned_dense_search(b.requests(spark, sf_dir), index, 10).hits


DENSE_FILTER = {
    "must": [{"key": "label", "match": [1, 3, 5, 7, 9]}, {"key": "n_chars", "range": {"gte": 200}}],
    "must_not": [{"key": "lang", "match": "de"}],
}


@query(
    "dense_topk_filtered",
    f"""WITH {b.POINTS_SQL}, {b.QUERIES_SQL},
d AS (SELECT query_id, id, {COSINE_SQL} AS score FROM q, (SELECT id, dense AS embedding FROM points
  WHERE label IN (1, 3, 5, 7, 9) AND n_chars >= 200 AND coalesce(lang <> 'de', true) AND dense IS NOT NULL))
{b.top_sql('d', 10)}""",
)
def dense_topk_filtered(spark, sf_dir):
    return dense_search(b.requests(spark, sf_dir), b.points(spark, sf_dir), 10, filter=DENSE_FILTER)


def _metric_sql(metric: str, expression: str, direction: str) -> str:
    return f"""SELECT '{metric}' AS metric, * FROM ({b.top_sql(
        f"(SELECT query_id, CAST(vec_id AS VARCHAR) AS id, round({expression}, 6) AS score FROM q, embeddings)", 5, direction)})"""


@query(
    "dense_metrics",
    f"WITH {b.QUERIES_SQL} "
    + " UNION ALL ".join(
        [
            _metric_sql("dot", "list_inner_product(v, embedding::DOUBLE[])", "DESC"),
            _metric_sql("euclid", "list_distance(v, embedding::DOUBLE[])", "ASC"),
            _metric_sql("manhattan", "list_sum(list_transform(list_zip(v, embedding::DOUBLE[]), lambda x: abs(x[1] - x[2])))", "ASC"),
        ]
    ),
)
def dense_metrics(spark, sf_dir):
    requests, points = b.requests(spark, sf_dir), b.embedded(spark, sf_dir)
    found = [
        dense_search(requests, points, 5, metric=m).withColumn("metric", F.lit(m)) for m in ("dot", "euclid", "manhattan")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "named_vector_topk",
    f"""WITH {b.QUERIES_SQL},
d AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id,
  round(list_inner_product(v, list_transform(embedding::DOUBLE[], lambda x: -x)), 6) AS score FROM q, embeddings)
{b.top_sql('d', 5)}""",
)
def named_vector_topk(spark, sf_dir):
    two = b.embedded(spark, sf_dir).withColumn("opposite", F.transform("dense", lambda x: -x))
    return dense_search(b.requests(spark, sf_dir), two, 5, metric="dot", using="opposite")


SPARSE_SCORES_SQL = """
s AS (
  SELECT query_id, id, ((sum(CAST(round(t.value * 1e6) AS BIGINT) * CAST(round(p.value * 1e6) AS BIGINT)) + 500000) // 1000000) / 1e6 AS score
  FROM t JOIN p ON t.index = p.index GROUP BY query_id, id
)"""
IDF_SQL = """
n AS (SELECT count(DISTINCT id) AS n FROM p),
df AS (SELECT index, count(*) AS df FROM p GROUP BY index),
ti AS (SELECT query_id, t.index, round(value * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS value FROM t JOIN df ON df.index = t.index, n)"""
SPARSE_IDF_SCORES_SQL = IDF_SQL + "," + SPARSE_SCORES_SQL.replace("FROM t JOIN p", "FROM ti t JOIN p")


@query("sparse_topk", f"WITH {b.DOC_TERMS_SQL}, {b.QUERY_TERMS_SQL}, {SPARSE_SCORES_SQL} {b.top_sql('s', 10)}")
def sparse_topk(spark, sf_dir):
    return sparse_search(b.sparse_requests(spark, sf_dir), b.sparse_texts(spark, sf_dir), 10)


@query("pruned_sparse_topk", f"WITH {b.DOC_TERMS_SQL}, {b.QUERY_TERMS_SQL}, {SPARSE_SCORES_SQL} {b.top_sql('s', 10)}")
def pruned_sparse_topk(spark, sf_dir):
    """The same hits from blocks that know the largest weight of each term."""
    index = build_sparse_index(b.sparse_texts(spark, sf_dir), scratch_path(spark, "impacts"))
    return pruned_sparse_search(b.sparse_requests(spark, sf_dir), index, 10).hits


TERMS_SPEC = CollectionSpec("terms_v1", 64, sparse_vector_name="sparse", sparse_modifier="idf", buckets=8)


@query("sparse_topk_idf", f"WITH {b.DOC_TERMS_SQL}, {b.QUERY_TERMS_SQL}, {SPARSE_IDF_SCORES_SQL} {b.top_sql('s', 10)}")
def sparse_topk_idf(spark, sf_dir):
    """A stored table has its document frequencies already; a search does not count them."""
    table = PointTable(spark, scratch_path(spark, "idf"), TERMS_SPEC)
    table.ensure()
    table.load(b.sparse_texts(spark, sf_dir).select("id", "sparse"))
    return sparse_search(b.sparse_requests(spark, sf_dir), table.read(), 10, idf=True, statistics=table.statistics())


@query(
    "term_statistics",
    f"WITH {b.DOC_TERMS_SQL}, n AS (SELECT count(DISTINCT id) AS n FROM p) "
    "SELECT index, count(*) AS df, any_value(n.n) AS n FROM p, n GROUP BY index",
)
def all_term_statistics(spark, sf_dir):
    found = term_statistics(b.sparse_texts(spark, sf_dir))
    return found.select(F.col("index").cast("bigint").alias("index"), "df", "n")


def _sparse_points(spark, sf_dir):
    """The collection as it would be stored: terms are made once, then read by statistics and scoring."""
    terms = b.sparse_texts(spark, sf_dir).select("id", "lang", "sparse")
    return written(terms.join(b.embedded(spark, sf_dir).select("id", "dense"), "id", "full_outer"), "points")


def _sparse_queries(spark, sf_dir):
    return b.requests(spark, sf_dir).withColumn("sparse", sparse_terms(F.col("text")))


HYBRID_SQL = f"""
dr AS ({b.top_sql('d', 10)}), sr AS ({b.top_sql('s', 10)}),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM dr UNION ALL SELECT * FROM sr) GROUP BY query_id, id)"""
HYBRID_BASE_SQL = f"{b.DOC_TERMS_SQL}, {b.QUERY_TERMS_SQL}, {SPARSE_IDF_SCORES_SQL}, {b.QUERIES_SQL}, {DENSE_SCORES_SQL}, {HYBRID_SQL}"


@query("hybrid_topk", f"WITH {HYBRID_BASE_SQL} {b.top_sql('f', 10)}")
def hybrid_topk(spark, sf_dir):
    return hybrid_search(_sparse_queries(spark, sf_dir), _sparse_points(spark, sf_dir), 10, idf=True)


@query(
    "hybrid_post_filter",
    f"""WITH {b.POINTS_SQL}, {HYBRID_BASE_SQL},
g AS (SELECT * FROM f WHERE id IN (SELECT id FROM points WHERE lang = 'en')) {b.top_sql('g', 10)}""",
)
def hybrid_post_filter(spark, sf_dir):
    return hybrid_search(
        _sparse_queries(spark, sf_dir), _sparse_points(spark, sf_dir), 10, idf=True, filter={"lang": "en"}, filter_stage="post"
    )


@query(
    "search_with_payload",
    f"""WITH {b.POINTS_SQL}, {b.QUERIES_SQL}, {DENSE_SCORES_SQL}, h AS ({b.top_sql('d', 5)})
SELECT h.*, lang, source, text, list_extract(dense, 1)::DOUBLE AS first_value FROM h LEFT JOIN points USING (id)""",
)
def search_with_payload(spark, sf_dir):
    points = b.points(spark, sf_dir)
    hits = dense_search(b.requests(spark, sf_dir), b.embedded(spark, sf_dir), 5)
    wide = attach_points(hits, points, ["lang", "source", "text", "dense"])
    return wide.withColumn("first_value", F.get("dense", F.lit(0)).cast("double")).drop("dense")


def _mode_requests(spark, sf_dir):
    """Every benchmark item asks in a mode of its own making: by the length of its text."""
    n = F.length("text") % 5
    return b.requests(spark, sf_dir).select(
        "query_id",
        F.when(n == 3, F.lit(None)).otherwise(F.col("text")).alias("text"),
        F.when(n == 4, F.lit("?!")).when(n == 2, F.col("text")).alias("query_text"),
        F.when(n != 1, F.col("vector")).alias("vector"),
        F.when(n == 0, "AUTO").when(n == 1, "sparse").when(n == 2, "dense").when(n == 4, "hybrid").alias("search_mode"),
        F.when(F.length("text") % 2 == 0, "hybrid").alias("default_mode"),
        (F.length("text") % 3 > 0).alias("has_sparse"),
        (1 + F.length("text") % 7).cast("bigint").alias("limit"),
    )


MODE_SQL = """
m AS (
  SELECT item_id AS query_id, CASE WHEN length(text) % 5 = 3 THEN NULL ELSE text END AS text,
    CASE length(text) % 5 WHEN 4 THEN '?!' WHEN 2 THEN text END AS query_text,
    CASE WHEN length(text) % 5 <> 1 THEN embedding END AS vector,
    CASE length(text) % 5 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'sparse' WHEN 2 THEN 'dense' WHEN 4 THEN 'hybrid' END AS search_mode,
    CASE WHEN length(text) % 2 = 0 THEN 'hybrid' END AS default_mode, length(text) % 3 > 0 AS has_sparse,
    1 + length(text) % 7 AS lim
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id
),
mt AS (
  SELECT *, len(regexp_extract_all(coalesce(query_text, text, ''), '[\\p{L}\\p{N}_]+')) > 0 AS has_terms, vector IS NOT NULL AS has_dense,
    CASE WHEN lower(coalesce(search_mode, 'auto')) <> 'auto' THEN lower(search_mode) WHEN default_mode IS NOT NULL THEN default_mode
      WHEN has_sparse THEN 'hybrid' ELSE 'dense' END AS asked
  FROM m
),
modes AS (
  SELECT *, CASE WHEN asked IN ('hybrid', 'sparse') AND NOT (has_sparse AND has_terms) THEN 'dense'
    WHEN asked = 'hybrid' AND NOT has_dense THEN 'sparse' ELSE asked END AS mode FROM mt
)"""


def _resolved(spark, sf_dir):
    requests = text_queries(_mode_requests(spark, sf_dir))
    return resolve_mode(
        requests.withColumn("has_terms", F.col("sparse").isNotNull()).withColumn("has_dense", F.col("vector").isNotNull())
    )


@query("mode_resolution", f"WITH {MODE_SQL} SELECT query_id, has_terms, has_dense, mode FROM modes")
def mode_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("query_id", "has_terms", "has_dense", "mode")


@query(
    "search_requests",
    f"""WITH {MODE_SQL}, {b.DOC_TERMS_SQL},
{b.terms_sql('t', 'query_id', "(SELECT query_id, coalesce(query_text, text) AS text FROM modes WHERE mode IN ('sparse', 'hybrid'))")},
{SPARSE_IDF_SCORES_SQL},
q AS (SELECT query_id, vector::DOUBLE[] AS v FROM modes WHERE vector IS NOT NULL AND mode IN ('dense', 'hybrid')),
{DENSE_SCORES_SQL},
dr AS (SELECT r.*, mode FROM ({b.top_sql('d', 7)}) r JOIN modes USING (query_id) WHERE rank <= lim),
sr AS (SELECT r.*, mode FROM ({b.top_sql('s', 7)}) r JOIN modes USING (query_id) WHERE rank <= lim),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
  FROM (SELECT * FROM dr WHERE mode = 'hybrid' UNION ALL SELECT * FROM sr WHERE mode = 'hybrid') GROUP BY query_id, id)
SELECT query_id, mode, rank, id, score FROM dr WHERE mode = 'dense'
UNION ALL SELECT query_id, mode, rank, id, score FROM sr WHERE mode = 'sparse'
UNION ALL SELECT query_id, 'hybrid', rank, id, score FROM ({b.top_sql('f', 7)}) JOIN modes USING (query_id) WHERE rank <= lim""",
)
def mixed_requests(spark, sf_dir):
    return search_requests(_resolved(spark, sf_dir), _sparse_points(spark, sf_dir), idf=True)


SERVED_SPECS = {
    "docs_v1": CollectionSpec(
        "docs_v1", 64, sparse_vector_name="sparse", sparse_modifier="idf", buckets=8,
        payload_types=(("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")),
    ),
    "cards_v1": CollectionSpec("cards_v1", 64, distance="Dot", vector_name="summary", payload_types=(("label", "bigint"),), buckets=4),
}
# By number of the request; the first is none.
SERVED_FILTERS = {
    "docs_v1": [
        None, "{}", '{"lang": "en"}', '{"must": [{"key": "n_chars", "range": {"gte": 300}}], "must_not": [{"key": "lang", "match": "de"}]}',
        '{"quality": 1}', '{"must": "lang"}',
    ],
    "cards_v1": [None, "{}", '{"label": [1, 2, 3]}', '{"must_not": [{"key": "label", "match": 0}]}', '{"must": [{"key": "label", "range": {"lt": 5}}]}', "[]"],
}

SERVICE_SQL = """
m AS (
  SELECT item_id AS query_id, CASE item_id % 7 WHEN 0 THEN 'docs' WHEN 1 THEN 'nowhere' WHEN 2 THEN 'cards_v1' WHEN 3 THEN 'cards_v1' ELSE 'docs_v1' END AS collection,
    item_id % 6 AS fid, CASE WHEN length(text) % 5 = 3 THEN NULL ELSE text END AS text,
    CASE length(text) % 5 WHEN 4 THEN '?!' WHEN 2 THEN text END AS query_text,
    CASE WHEN length(text) % 5 <> 1 THEN embedding END AS vector,
    CASE length(text) % 5 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'sparse' WHEN 2 THEN 'dense' WHEN 4 THEN 'hybrid' END AS search_mode,
    CASE WHEN item_id % 4 > 0 THEN 1 + length(text) % 7 END AS lim
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id
),
mt AS (
  SELECT *, CASE WHEN collection IN ('docs', 'docs_v1') THEN 'docs_v1' ELSE collection END AS target, CASE WHEN collection = 'docs' THEN 'hybrid' END AS default_mode,
    len(regexp_extract_all(coalesce(query_text, text, ''), '[\\p{L}\\p{N}_]+')) > 0 AS has_terms, vector IS NOT NULL AS has_dense FROM m
),
ma AS (
  SELECT *, target = 'docs_v1' AS has_sparse, lower(coalesce(search_mode, 'auto')) AS own,
    CASE WHEN lower(coalesce(search_mode, 'auto')) <> 'auto' THEN lower(search_mode) WHEN default_mode IS NOT NULL THEN default_mode
      WHEN target = 'docs_v1' THEN 'hybrid' ELSE 'dense' END AS asked FROM mt
),
mm AS (
  SELECT *, CASE WHEN asked IN ('hybrid', 'sparse') AND NOT (has_sparse AND has_terms) THEN 'dense' WHEN asked = 'hybrid' AND NOT has_dense THEN 'sparse' ELSE asked END AS mode FROM ma
),
sr0 AS (
  SELECT *, CASE WHEN text IS NULL AND query_text IS NULL AND vector IS NULL THEN 'One of ''text'', ''query_text'', or ''vector'' is required'
    WHEN target = 'nowhere' THEN 'Unknown collection: nowhere'
    WHEN mode = 'dense' AND NOT has_dense THEN 'Collection ''' || collection || ''' requires a dense vector for query mode ''' || own || ''''
    WHEN fid = 5 THEN '''filter'' is not valid' END AS reason FROM mm
),
modes AS (SELECT * REPLACE (coalesce(lim, 5) AS lim) FROM sr0 WHERE reason IS NULL)"""


def _service(spark, sf_dir):
    root = scratch_path(spark, "served")
    stored = {name: PointTable(spark, root, spec) for name, spec in SERVED_SPECS.items()}
    for table in stored.values():
        table.ensure()
    labels = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"), "quality")
    docs = b.texts(spark, sf_dir).join(b.embedded(spark, sf_dir).select("id", "dense"), "id", "left").join(labels, "id", "left")
    stored["docs_v1"].load(docs)
    stored["cards_v1"].load(b.embedded(spark, sf_dir))
    served = {n: Served(t.read(), t.spec, t.statistics() if t.spec.idf else None) for n, t in stored.items()}
    routing = spark.createDataFrame([("docs", "docs_v1", "hybrid")], "logical_name string, read_target string, default_mode string")
    name = F.col("query_id") % 7
    size = F.length("text")

    def chosen(texts):
        return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), F.col("query_id").cast("int") % 6)

    requests = b.requests(spark, sf_dir).withColumn(
        "collection", F.when(name == 0, "docs").when(name == 1, "nowhere").when(name.isin(2, 3), "cards_v1").otherwise("docs_v1")
    )
    requests = requests.select(
        "query_id", "collection",
        F.when(F.col("collection") == "cards_v1", chosen(SERVED_FILTERS["cards_v1"])).otherwise(chosen(SERVED_FILTERS["docs_v1"])).alias("filter"),
        F.when(size % 5 != 3, F.col("text")).alias("text"), F.when(size % 5 == 4, "?!").when(size % 5 == 2, F.col("text")).alias("query_text"),
        F.when(size % 5 != 1, F.col("vector")).alias("vector"),
        F.when(size % 5 == 0, "AUTO").when(size % 5 == 1, "sparse").when(size % 5 == 2, "dense").when(size % 5 == 4, "hybrid").alias("search_mode"),
        F.when(F.col("query_id") % 4 > 0, 1 + size % 7).cast("bigint").alias("limit"),
    )
    return search_service(requests, served, routing=routing)


@query(
    "search_service",
    f"""WITH {SERVICE_SQL}, {b.DOC_TERMS_SQL},
{b.terms_sql('t', 'query_id', "(SELECT query_id, coalesce(query_text, text) AS text FROM modes WHERE mode IN ('sparse', 'hybrid'))")},
{SPARSE_IDF_SCORES_SQL},
pay AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, lang, n_chars, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
open AS (
  SELECT query_id, id FROM modes, pay WHERE target = 'docs_v1' AND CASE fid WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN lang = 'en'
    WHEN 3 THEN n_chars >= 300 AND coalesce(lang <> 'de', true) WHEN 4 THEN quality = 1 END
  UNION ALL
  SELECT query_id, CAST(vec_id AS VARCHAR) FROM modes, embeddings WHERE target = 'cards_v1' AND CASE fid WHEN 0 THEN true WHEN 1 THEN true
    WHEN 2 THEN label IN (1, 2, 3) WHEN 3 THEN label <> 0 WHEN 4 THEN label < 5 END),
q AS (SELECT query_id, target, vector::DOUBLE[] AS v FROM modes WHERE mode IN ('dense', 'hybrid')),
d AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id, {COSINE_SQL} AS score FROM q, embeddings WHERE target = 'docs_v1'
  UNION ALL SELECT query_id, CAST(vec_id AS VARCHAR), round(list_inner_product(v, embedding::DOUBLE[]), 6) FROM q, embeddings WHERE target = 'cards_v1'),
dd AS (SELECT d.* FROM d JOIN open USING (query_id, id)),
ss AS (SELECT s.* FROM s JOIN open USING (query_id, id)),
dr AS (SELECT r.*, mode, collection FROM ({b.top_sql('dd', 7)}) r JOIN modes USING (query_id) WHERE rank <= lim),
sr AS (SELECT r.*, mode, collection FROM ({b.top_sql('ss', 7)}) r JOIN modes USING (query_id) WHERE rank <= lim),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
  FROM (SELECT * FROM dr WHERE mode = 'hybrid' UNION ALL SELECT * FROM sr WHERE mode = 'hybrid') GROUP BY query_id, id)
SELECT query_id, collection, mode, rank, id, score FROM dr WHERE mode = 'dense'
UNION ALL SELECT query_id, collection, mode, rank, id, score FROM sr WHERE mode = 'sparse'
UNION ALL SELECT query_id, collection, 'hybrid', rank, id, score FROM ({b.top_sql('f', 7)}) JOIN modes USING (query_id) WHERE rank <= lim""",
)
def served_requests(spark, sf_dir):
    """Requests of every mode to two stored collections, one of them also by a logical name, each with a filter of its own."""
    return _service(spark, sf_dir)[0]


@query("search_service_rejects", f"WITH {SERVICE_SQL} SELECT query_id, reason FROM sr0 WHERE reason IS NOT NULL")
def rejected_requests(spark, sf_dir):
    return _service(spark, sf_dir)[1].withColumn("reason", F.regexp_replace("reason", "(is not valid):.*", "$1"))


@query(
    "request_checks",
    f"""WITH {MODE_SQL} SELECT query_id, CASE
  WHEN text IS NULL AND query_text IS NULL AND vector IS NULL THEN 'One of ''text'', ''query_text'', or ''vector'' is required'
  WHEN lim * 300 > 1000 THEN '''limit'' must be between 1 and 1000'
  WHEN search_mode = 'sparse' AND vector IS NOT NULL THEN '''vector'' is not allowed when ''search_mode'' is ''sparse'''
  WHEN lower(search_mode) = 'hybrid' AND length(text) % 2 = 0 THEN '''search_mode'' must be one of: auto, dense, sparse, hybrid'
  END AS reason FROM modes""",
)
def request_checks(spark, sf_dir):
    odd = F.when((F.col("search_mode") == "hybrid") & (F.length("text") % 2 == 0), "lexical").otherwise(F.col("search_mode"))
    asked = _mode_requests(spark, sf_dir).withColumn("limit", F.col("limit") * 300).withColumn("search_mode", odd)
    return check(asked, query_rules()).select("query_id", "reason")


@query(
    "text_search",
    f"""WITH
tok AS (SELECT 'q' AS side, CAST(item_id AS VARCHAR) AS id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM benchmark
  UNION ALL SELECT 'p', CAST(doc_id AS VARCHAR), lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) FROM documents),
cell AS (SELECT side, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS d,
  sum(1 - 2 * (('0x' || substr(md5(w), 9, 1))::BIGINT % 2)) AS x FROM tok GROUP BY side, id, d),
size AS (SELECT side, id, sqrt(sum(x * x)::DOUBLE) AS l FROM cell GROUP BY side, id),
d AS (SELECT CAST(a.id AS BIGINT) AS query_id, c.id, round(sum(a.x * c.x)::DOUBLE / (any_value(sa.l) * any_value(sc.l)), 6) AS score
  FROM cell a JOIN cell c ON a.d = c.d AND a.side = 'q' AND c.side = 'p'
  JOIN size sa ON sa.side = 'q' AND sa.id = a.id JOIN size sc ON sc.side = 'p' AND sc.id = c.id
  WHERE sa.l > 0 AND sc.l > 0 GROUP BY a.id, c.id)
{b.top_sql('d', 5)}""",
)
def text_search(spark, sf_dir):
    """Queries and documents embedded by the stand-in model, whose raw vectors are whole numbers."""
    embedder = HashEmbedder(64)
    items = b.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.lit(None).cast("string").alias("query_text")
    )
    asked = text_queries(items).select("query_id", "dense_text")
    asked = embed_texts(asked, "dense_text", embedder, unit_length=False)
    points = b.texts(spark, sf_dir).select("id", "text")
    points = embed_texts(points, "text", embedder, into="dense", unit_length=False)
    return dense_search(asked, points, 5, vector_size=64)


# --- filters --------------------------------------------------------------------------------------------

KEEP = ["id", "label", "lang", "source", "n_chars", "quality", "toxic"]


def _filter_query(name: str, spec, where: str):
    @query(name, f"WITH {b.POINTS_SQL} SELECT {', '.join(KEEP)} FROM points WHERE {where}")
    def run(spark, sf_dir):
        return apply_filter(b.points(spark, sf_dir), spec).select(*KEEP)

    return run


_filter_query("filter_match", {"must": [{"key": "lang", "match": "fr"}, {"key": "toxic", "match": True}]}, "lang = 'fr' AND toxic")
_filter_query("filter_match_any", {"must": [{"key": "source", "match": ["src1", "src2"]}]}, "source IN ('src1', 'src2')")
_filter_query("filter_range", {"must": [{"key": "n_chars", "range": {"gt": 300, "lte": 900.5}}]}, "n_chars > 300 AND n_chars <= 900.5")
_filter_query(
    "filter_must_should_not",
    {
        "must": [{"key": "n_chars", "range": {"gte": 100}}],
        "should": [{"key": "lang", "match": "en"}, {"key": "label", "match": [2, 4]}],
        "must_not": [{"key": "toxic", "match": True}, {"key": "quality", "match": 0}],
        "lang": "ignored beside clauses",
    },
    "n_chars >= 100 AND (lang = 'en' OR label IN (2, 4)) AND NOT coalesce(toxic, false) AND NOT coalesce(quality = 0, false)",
)
_filter_query("filter_shorthand", {"lang": ["en", "es"], "quality": 1}, "lang IN ('en', 'es') AND quality = 1")
_filter_query("filter_empty", {"must": [], "should": None}, "true")
_filter_query("filter_missing_key", {"must_not": [{"key": "nowhere", "match": 1}], "should": [{"key": "label", "match": "3"}, {"key": "lang", "match": "de"}]}, "lang = 'de'")


@query(
    "filter_datetime",
    "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:30:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'",
)
def filter_datetime(spark, sf_dir):
    spec = {"must": [{"key": "ts", "range": {"gte": "2024-01-10T06:30:00Z", "lt": "2024-01-20T00:00:00+00:00"}}]}
    return apply_filter(b.table(spark, sf_dir, "events"), spec).select("event_id", "user_id", "event_type")


@query("count_filtered", f"WITH {b.POINTS_SQL} SELECT count(*) AS count FROM points WHERE lang = 'en' AND label IN (0, 1, 2)")
def count_filtered(spark, sf_dir):
    return tables.count(b.points(spark, sf_dir), {"lang": "en", "label": [0, 1, 2]})


@query(
    "scroll_page",
    f"WITH {b.POINTS_SQL} SELECT {', '.join(KEEP)} FROM points WHERE lang = 'en' AND id > '2' ORDER BY id LIMIT 50",
)
def scroll_page(spark, sf_dir):
    page = tables.scroll(b.points(spark, sf_dir), {"lang": "en"}, 50, after_id="2")
    return page.select(*KEEP)


@query(
    "retrieve_ids",
    "SELECT CAST(vec_id AS VARCHAR) AS id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings"
    " WHERE CAST(vec_id AS VARCHAR) IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
)
def retrieve_ids(spark, sf_dir):
    ids = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"))
    found = tables.retrieve(b.embedded(spark, sf_dir), ids, with_vectors=True)
    total = F.aggregate("dense", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return found.select("id", "label", F.round(total, 4).alias("total"))
