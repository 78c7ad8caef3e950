"""Validation queries: faults are planted by what a row already is (label, role, event type), and every row is checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators.validate import (
    check, chunk_rules, dense_rules, embed_rules, id_rules, model_rules, named_rules, patch_rules, request_sizes,
    size_rules, sparse_rules, spec_rules, split, target_rules, text_rules, texts_rules,
)
from vecloom.plans import bindings as b
from vecloom.plans.registry import query
from vecloom.plans.text import CATALOG, MODEL_SQL, _model_requests, _named_points
from vecloom.operators.embed import select_models
from vecloom.spec import Catalog, CollectionSpec


@query(
    "validate_text",
    """SELECT conv_id, turn, CASE WHEN role IS NULL OR trim(CASE role WHEN 'user' THEN text WHEN 'assistant' THEN E' \\t ' || left(text, turn::INT) END, E' \\t\\n') = ''
  OR role NOT IN ('user', 'assistant') THEN '''text'' must not be blank' END AS reason FROM conversations""",
)
def validate_text(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations")
    padded = F.concat(F.lit(" \t "), F.substring("text", F.lit(1), F.col("turn").cast("int")))
    turns = turns.withColumn("text", F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "assistant", padded))
    return check(turns, text_rules("text")).select("conv_id", "turn", "reason")


@query(
    "validate_text_lists",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '''texts'' must not be empty'
  WHEN o_orderstatus = 'P' THEN '''texts[1]'' must not be blank' END AS reason FROM orders""",
)
def validate_text_lists(spark, sf_dir):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    lists = F.when(s == "O", F.array().cast("array<string>")).when(s == "P", F.array(p, F.lit(" 　"))).otherwise(F.array(p, p))
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", lists.alias("texts"))
    return check(orders, texts_rules("texts")).select("o_orderkey", "reason")


def _faulty_vectors(spark, sf_dir):
    label, v = F.col("label"), F.col("embedding")
    bad = F.when(label == 3, F.lit(float("nan"))).when(label == 9, F.lit(float("inf"))).cast("float")
    broken = F.when(label.isin(3, 9), F.transform(v, lambda x, i: F.when(i == label, bad).otherwise(x)))
    changed = broken
    changed = F.when(label == 5, F.slice(v, 1, 32)).when(label == 7, F.slice(v, 1, 0)).when(label == 1, F.lit(None)).otherwise(F.coalesce(changed, v))
    return b.table(spark, sf_dir, "embeddings").select("vec_id", "label", changed.alias("vector"))


@query(
    "validate_dense",
    """SELECT vec_id, CASE WHEN label IN (3, 9) THEN '''vector[' || label || ']'' must be a finite number'
  WHEN label = 5 THEN 'Collection ''points'' expects dense vector size 64, got 32'
  WHEN label = 7 THEN '''vector'' must not be empty' END AS reason FROM embeddings""",
)
def validate_dense(spark, sf_dir):
    v = F.col("vector")
    rules = dense_rules(v, "vector") + size_rules(v, F.lit("points"), F.lit(64))
    return check(_faulty_vectors(spark, sf_dir), rules).select("vec_id", "reason")


@query(
    "valid_vectors",
    "SELECT vec_id, label FROM embeddings WHERE label NOT IN (3, 5, 7, 9)",
)
def valid_vectors(spark, sf_dir):
    v = F.col("vector")
    good, _ = split(_faulty_vectors(spark, sf_dir), dense_rules(v, "vector") + size_rules(v, F.lit("points"), F.lit(64)))
    return good.select("vec_id", "label")


@query(
    "validate_sparse",
    """WITH s AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)
SELECT event_id, CASE
  WHEN t = 'view' THEN CASE WHEN k < 50 THEN '''vector'' sparse vector must include list ''indices'' and ''values''' ELSE '''vector.indices'' must not be empty' END
  WHEN t = 'click' THEN '''vector'' sparse vector requires the same number of indices and values'
  WHEN t = 'signup' THEN CASE WHEN k < 3 THEN '''vector.indices[0]'' must be non-negative' WHEN k > 60 THEN '''vector.indices'' must be strictly increasing' END
  WHEN t = 'error' AND value > 20 THEN '''vector.values[1]'' must be a finite number' END AS reason FROM s""",
)
def validate_sparse(spark, sf_dir):
    kind, k = F.col("event_type"), b.json_k().cast("int")
    two = F.array(F.col("value"), F.col("value"))
    sixty = F.when(kind == "signup", F.lit(60)).otherwise(k + 1)
    start = F.when(kind == "signup", k - 3 + F.when(k > 2, 3).otherwise(0)).otherwise(k)
    indices = F.when(kind == "view", F.when(k >= 50, F.array().cast("array<int>"))).otherwise(F.array(start, sixty))
    # k == 60 would repeat an index; move it out of the way.
    indices = F.when((kind == "signup") & (k == 60), F.array(F.lit(59), F.lit(60))).otherwise(indices)
    values = (
        F.when(kind == "view", two).when(kind == "click", F.array(F.col("value")))
        .when((kind == "error") & (F.col("value") > 20), F.array(F.col("value"), F.lit(float("nan")))).otherwise(two)
    )
    rows = b.table(spark, sf_dir, "events").select("event_id", F.struct(indices.alias("indices"), values.alias("values")).alias("v"))
    return check(rows, sparse_rules(F.col("v"), "vector")).select("event_id", "reason")


@query(
    "validate_named",
    """SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label > 6 THEN '''vector'' must not be empty'
  WHEN label = 0 THEN '''vector.title'' must not be empty' WHEN label = 6 THEN '''vector.terms.indices'' must be strictly increasing' END AS reason FROM embeddings""",
)
def validate_named(spark, sf_dir):
    label = F.col("label")
    pair = F.struct(
        F.array(F.when(label == 6, 5).otherwise(1), F.lit(2)).alias("indices"), F.array(F.lit(0.5), F.lit(0.5)).alias("values")
    )
    points = _named_points(spark, sf_dir).withColumns(
        {
            "title": F.when(label == 0, F.array().cast("array<float>")).otherwise(F.col("title")),
            "terms": F.when(label <= 6, pair),
        }
    )
    return check(points, named_rules(points, ["summary", "title", "terms"])).select("id", "reason")


@query(
    "validate_ids",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '''id'' must not be blank' END AS reason FROM customer",
)
def validate_ids(spark, sf_dir):
    blank = F.col("c_mktsegment") == "BUILDING"
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", F.when(blank, " \n").otherwise(F.col("c_name")).alias("id"))
    return check(rows, id_rules()).select("c_custkey", "reason")


@query(
    "validate_request_sizes",
    """SELECT c_custkey AS request, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN '''points'' must not be empty'
  WHEN n > 12 THEN '''points'' must contain at most 12 items' END AS reason
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def validate_request_sizes(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"))
    requests = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"))
    return request_sizes(rows, requests, "request", "points", cap=12)


@query(
    "validate_targets",
    """SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label >= 4 THEN 'Collection ''summaries'' requires a dense vector payload for upsert'
  WHEN label IN (2, 3) THEN 'Collection ''single'' requires a dense vector payload for upsert'
  ELSE 'Collection ''short'' expects dense vector size 32, got 64' END AS reason FROM embeddings""",
)
def validate_targets(spark, sf_dir):
    points = _named_points(spark, sf_dir)
    catalog = Catalog(
        (CollectionSpec("summaries", 64, vector_name="summary"), CollectionSpec("single", 64), CollectionSpec("short", 32, vector_name="summary"))
    )
    rules = target_rules(points, catalog, ["summaries", "single", "short"], ["summary", "title"])
    return check(points, rules).select("id", "reason")


@query(
    "validate_models",
    f"""WITH {MODEL_SQL}, z AS (SELECT *, CASE model WHEN 'default' THEN 64 WHEN 'small' THEN 32 WHEN 'large' THEN 128 END AS made,
  CASE physical WHEN 'view_v1' THEN 64 WHEN 'click_v1' THEN 64 WHEN 'signup_v1' THEN 32 END AS wanted FROM rm)
SELECT event_id, CASE WHEN made <> wanted THEN 'Model ''' || model || ''' produces ' || made || '-dim vectors but collection ''' || physical
  || ''' expects ' || wanted || ' for query' END AS reason FROM z""",
)
def validate_models(spark, sf_dir):
    chosen = select_models(_model_requests(spark, sf_dir), CATALOG, "query")
    return check(chosen, model_rules(CATALOG, "query")).select("event_id", "reason")


@query(
    "validate_embed_requests",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN turn > 2 THEN 'Provide either ''text'' or ''texts'', not both' END
  WHEN 'assistant' THEN CASE WHEN turn = 1 THEN 'One of ''text'' or ''texts'' is required' WHEN turn = 3 THEN '''texts[0]'' must not be blank' END END AS reason
FROM conversations""",
)
def validate_embed_requests(spark, sf_dir):
    role, turn, text = F.col("role"), F.col("turn"), F.col("text")
    user = role == "user"
    lists = F.when(user, F.when(turn > 2, F.array(text))).otherwise(
        F.when(turn == 1, F.array().cast("array<string>")).when(turn == 3, F.array(F.lit(""), text)).otherwise(F.array(text))
    )
    rows = b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(user | ~role.isin("user", "assistant"), text).alias("text"),
        F.when(role.isin("user", "assistant"), lists).alias("texts"),
    )
    return check(rows, embed_rules()).select("conv_id", "turn", "reason")


@query(
    "validate_chunks",
    f"""WITH {b.POINTS_SQL} SELECT id, CASE WHEN toxic OR (text IS NULL AND dense IS NULL) THEN 'Each chunk requires either ''text'' or ''vector'''
  WHEN quality = 0 THEN '''text'' must not be blank' WHEN lang = 'de' AND dense IS NOT NULL THEN '''vector[63]'' must be a finite number' END AS reason FROM points""",
)
def validate_chunks(spark, sf_dir):
    toxic, poor = F.coalesce("toxic", F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    broken = F.transform("dense", lambda x, i: F.when((F.col("lang") == "de") & (i == 63), F.lit(float("-inf")).cast("float")).otherwise(x))
    rows = b.points(spark, sf_dir).select(
        "id", F.when(toxic, F.lit(None)).when(poor, "\t").otherwise(F.col("text")).alias("chunk_text"),
        F.when(~toxic, broken).alias("vector"),
    )
    return check(rows, chunk_rules()).select("id", "reason")


@query(
    "validate_specs",
    """SELECT p_partkey, CASE p_size % 8 WHEN 1 THEN '''collection'' must not be blank' WHEN 2 THEN '''vector_size'' must be greater than 0'
  WHEN 3 THEN '''vector_name'' must not be blank' WHEN 4 THEN '''sparse_vector_name'' must not be blank'
  WHEN 5 THEN '''vector_name'' and ''sparse_vector_name'' must be different' WHEN 6 THEN '''aliases[1]'' must not be blank'
  WHEN 7 THEN '''aliases'' must not contain duplicates' END AS reason FROM part""",
)
def validate_specs(spark, sf_dir):
    kind, brand = F.col("p_size") % 8, F.col("p_brand")
    rows = b.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(kind == 1, " ").otherwise(brand).alias("collection"),
        F.when(kind == 2, 0).otherwise(F.col("p_size") + 1).alias("vector_size"),
        F.when(kind == 3, "").when(kind == 5, "same").otherwise("dense").alias("vector_name"),
        F.when(kind == 4, " ").when(kind == 5, "same").alias("sparse_vector_name"),
        F.when(kind == 6, F.array(brand, F.lit(" "))).when(kind == 7, F.array(brand, F.lit("x"), brand)).otherwise(F.array(brand)).alias("aliases"),
    )
    return check(rows, spec_rules()).select("p_partkey", "reason")


@query(
    "validate_patches",
    "SELECT s_suppkey, CASE WHEN s_nationkey > 12 THEN '''payload'' must not be empty' END AS reason FROM supplier",
)
def validate_patches(spark, sf_dir):
    empty = F.col("s_nationkey") > 12
    rows = b.table(spark, sf_dir, "supplier").select(
        "s_suppkey", b.text_id("s_suppkey").alias("id"),
        F.when(empty, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("name"), F.col("s_name"))).alias("patch"),
    )
    return check(rows, patch_rules()).select("s_suppkey", "reason")
