"""Text, prefix, embedding and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions.prefix import as_text, render
from vecloom.functions.text import sparse_terms, tokens
from vecloom.functions.vectors import normalise
from vecloom.operators.embed import HashEmbedder, embed_texts, select_models
from vecloom.operators.mutate import copy_vector, default_id, sparse_from_payload
from vecloom.operators.prefix import apply_prefix, policy_owners
from vecloom.operators.validate import dense_of
from vecloom.plans import bindings as b
from vecloom.plans.registry import query
from vecloom.spec import Catalog, CollectionSpec, LogicalSpec, Model, PrefixPart, PrefixPolicy

TOKEN_SQL = "'[\\p{L}\\p{N}_]+'"


@query(
    "tokens",
    f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_transform(t, lambda x: lower(x)), ' ')) AS tokens_md5"
    f" FROM (SELECT doc_id, regexp_extract_all(text, {TOKEN_SQL}) AS t FROM documents)",
)
def document_tokens(spark, sf_dir):
    found = b.spread(b.table(spark, sf_dir, "documents")).select("doc_id", tokens(F.col("text")).alias("t"))
    return found.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5")
    )


def _exploded(vectors, key: str):
    pairs = F.arrays_zip(F.col("sparse.indices").alias("index"), F.col("sparse.values").alias("value"))
    return vectors.select(key, F.explode(pairs).alias("t")).select(
        key, F.col("t.index").cast("bigint").alias("index"), F.col("t.value").alias("value")
    )


@query(
    "sparse_terms",
    f"WITH {b.terms_sql('p', 'doc_id', 'documents')} SELECT doc_id, index, value FROM p",
)
def document_terms(spark, sf_dir):
    docs = b.spread(b.table(spark, sf_dir, "documents"))
    return _exploded(docs.select("doc_id", sparse_terms(F.col("text")).alias("sparse")), "doc_id")


@query(
    "sparse_from_payload",
    f"""WITH turns AS (SELECT conv_id * 1000 + turn AS id, CASE role WHEN 'user' THEN text WHEN 'system' THEN '   ' END AS text FROM conversations),
{b.terms_sql('p', 'id', 'turns')} SELECT id, index, value FROM p""",
)
def turn_terms(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "system", "   ").alias("text"),
    )
    return _exploded(sparse_from_payload(turns), "id")


# --- prefix ---------------------------------------------------------------------------------------------

POLICY = PrefixPolicy(parts=(PrefixPart("lang"), PrefixPart("source", "Source"), PrefixPart("quality", "Quality"), PrefixPart("toxic", "Toxic")))
PREFIX_SQL = (
    "'[' || concat_ws(' | ', nullif(trim(lang), ''), 'Source: ' || nullif(trim(source), ''), 'Quality: ' || quality,"
    " CASE WHEN toxic THEN 'Toxic: True' WHEN NOT toxic THEN 'Toxic: False' END) || ']'"
)
# Points without a document have a text of their own nowhere, so no prefix either.
CHUNKS_SQL = f"""
c AS (
  SELECT id, CASE WHEN label IS NULL OR label < 6 THEN text END AS chunk_text,
    CASE WHEN label >= 4 THEN text END AS text, lang, source, quality, toxic,
    CASE WHEN label = 7 THEN 'kept' END AS text_raw
  FROM points
),
cp AS (
  SELECT *, coalesce(CASE WHEN trim(chunk_text, E' \\n\\t') <> '' THEN chunk_text END, CASE WHEN trim(text, E' \\n\\t') <> '' THEN text END) AS base,
    CASE WHEN coalesce(lang, source, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)) IS NOT NULL THEN {PREFIX_SQL} END AS pre
  FROM c
),
px AS (
  SELECT *, CASE WHEN base IS NOT NULL THEN pre END AS prefix,
    CASE WHEN starts_with(base, pre) THEN base ELSE pre || E'\\n' || base END AS joined FROM cp
)"""


def _chunks(spark, sf_dir):
    p = b.points(spark, sf_dir)
    return p.select(
        "id",
        F.when(F.col("label").isNull() | (F.col("label") < 6), F.col("text")).alias("chunk_text"),
        F.when(F.col("label") >= 4, F.col("text")).alias("text"),
        "lang", "source", "quality", "toxic",
        F.when(F.col("label") == 7, "kept").alias("text_raw"),
    )


@query("prefix_render", f"WITH {b.POINTS_SQL}, {CHUNKS_SQL} SELECT id, pre AS prefix FROM cp")
def prefix_render(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return chunks.select("id", render(POLICY, chunks.schema).alias("prefix"))


PREFIX_OUT = ["id", "chunk_text", "text", "text_raw", "metadata_prefix"]


@query(
    "prefix_apply",
    f"""WITH {b.POINTS_SQL}, {CHUNKS_SQL} SELECT id, coalesce(CASE WHEN prefix IS NOT NULL THEN joined END, base, chunk_text) AS chunk_text,
  CASE WHEN prefix IS NOT NULL THEN joined ELSE text END AS text,
  CASE WHEN prefix IS NOT NULL THEN coalesce(text_raw, base) ELSE text_raw END AS text_raw, prefix AS metadata_prefix FROM px""",
)
def prefix_apply(spark, sf_dir):
    return apply_prefix(_chunks(spark, sf_dir), POLICY).select(*PREFIX_OUT)


@query(
    "prefix_twice",
    f"""WITH {b.POINTS_SQL}, {CHUNKS_SQL} SELECT id, coalesce(CASE WHEN prefix IS NOT NULL THEN joined END, base, chunk_text) AS chunk_text,
  CASE WHEN prefix IS NOT NULL THEN joined ELSE text END AS text,
  CASE WHEN prefix IS NOT NULL THEN coalesce(text_raw, base) ELSE text_raw END AS text_raw, prefix AS metadata_prefix FROM px""",
)
def prefix_twice(spark, sf_dir):
    """Applying the prefix again changes nothing."""
    return apply_prefix(apply_prefix(_chunks(spark, sf_dir), POLICY), POLICY).select(*PREFIX_OUT)


@query(
    "prefix_bulk",
    f"""WITH {b.POINTS_SQL}, {CHUNKS_SQL} SELECT id, coalesce(CASE WHEN prefix IS NOT NULL THEN joined END, base, chunk_text) AS chunk_text,
  CASE WHEN prefix IS NOT NULL THEN joined ELSE coalesce(text, base, chunk_text) END AS text, prefix AS metadata_prefix FROM px""",
)
def prefix_bulk(spark, sf_dir):
    return apply_prefix(_chunks(spark, sf_dir), POLICY, always_text=True).select("id", "chunk_text", "text", "metadata_prefix")


@query(
    "payload_as_text",
    """SELECT c_custkey, nullif(trim(c_mktsegment), '') AS a_string, CAST(c_nationkey AS VARCHAR) AS a_number,
  CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS a_bool,
  CASE WHEN c_nationkey > 20 THEN c_mktsegment ELSE c_mktsegment || ', ' || c_name END AS a_list, CAST(NULL AS VARCHAR) AS an_object
FROM customer""",
)
def payload_as_text(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit(" \t"), "c_mktsegment", F.lit("\n")).alias("s"), "c_nationkey", (F.col("c_acctbal") > 0).alias("flag"),
        F.array(F.col("c_mktsegment"), F.lit("  "), F.when(F.col("c_nationkey") <= 20, F.col("c_name"))).alias("l"),
        F.struct("c_name").alias("o"),
    )
    t = c.schema
    return c.select(
        "c_custkey", as_text(F.col("s"), t["s"].dataType).alias("a_string"),
        as_text(F.col("c_nationkey"), t["c_nationkey"].dataType).alias("a_number"),
        as_text(F.col("flag"), t["flag"].dataType).alias("a_bool"),
        as_text(F.col("l"), t["l"].dataType).alias("a_list"), as_text(F.col("o"), t["o"].dataType).alias("an_object"),
    )


@query(
    "policy_owners",
    """WITH logical AS (SELECT 'n' || n_nationkey AS name, ['r' || n_regionkey] AS r, ['w' || (n_nationkey % 8), 'r' || n_regionkey] AS w,
  n_nationkey % 3 = 0 AS enabled FROM nation),
t AS (SELECT DISTINCT name, unnest(list_concat(r, w)) AS collection FROM logical WHERE enabled)
SELECT name AS collection, name AS policy_owner FROM logical WHERE enabled
UNION ALL SELECT collection, min(name) FROM t GROUP BY collection HAVING count(*) = 1 AND collection NOT IN (SELECT name FROM logical)""",
)
def policies(spark, sf_dir):
    key, region = F.col("n_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    logical = b.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), key.cast("string")).alias("name"), F.array(region).alias("read_targets"),
        F.array(F.concat(F.lit("w"), (key % 8).cast("string")), region).alias("write_targets"), (key % 3 == 0).alias("prefix_enabled"),
    )
    return policy_owners(logical)


# --- vectors and models ---------------------------------------------------------------------------------


@query(
    "embed_texts",
    f"""WITH tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {TOKEN_SQL}))) AS w FROM documents),
cell AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, sum(1 - 2 * (('0x' || substr(md5(w), 9, 1))::BIGINT % 2)) AS x
  FROM tok GROUP BY doc_id, pos),
grid AS (SELECT doc_id, unnest(range(64)) AS pos FROM documents)
SELECT doc_id, pos, coalesce(x, 0)::DOUBLE AS value FROM grid LEFT JOIN cell USING (doc_id, pos)""",
)
def embed_documents(spark, sf_dir):
    docs = b.spread(b.table(spark, sf_dir, "documents").select("doc_id", "text"))
    vectors = embed_texts(docs, "text", HashEmbedder(64), unit_length=False)
    return vectors.select("doc_id", F.posexplode("vector").alias("pos", "value")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value")
    )


@query(
    "normalise_vectors",
    """SELECT vec_id, pos, round((x / n)::FLOAT::DOUBLE, 5) AS value FROM (SELECT vec_id, sqrt(list_inner_product(v, v)) AS n, unnest(v) AS x, unnest(range(64)) AS pos
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda y: y * (1 + label)) AS v FROM embeddings))""",
)
def normalise_vectors(spark, sf_dir):
    scaled = b.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).alias("v")
    )
    unit = scaled.select("vec_id", F.posexplode(normalise(F.col("v"))).alias("pos", "x"))
    return unit.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), 5).alias("value"))


CATALOG = Catalog(
    collections=(
        CollectionSpec("view_v1", 64, models={"any": "small"}, vector_name="dense", sparse_vector_name="sparse"),
        CollectionSpec("click_v1", 64, models={"any": "small", "query": "large"}),
        CollectionSpec("signup_v1", 32, vector_name="summary"),
    ),
    logical=(LogicalSpec("view", ("view_v1",), models={"query": "large"}), LogicalSpec("click", ("click_v1",))),
    models=(Model("default", "vendor/base", 64), Model("small", "vendor/small", 32), Model("large", "vendor/large", 128)),
)


def _model_requests(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(value > 10, kind).otherwise(F.concat(kind, F.lit("_v1"))).alias("collection"),
        F.concat(kind, F.lit("_v1")).alias("physical"),
        F.when(value > 80, "vendor/small").when(value > 60, "unregistered").when(value > 40, "large").alias("asked_model"),
    )


MODEL_SQL = """
r AS (SELECT event_id, CASE WHEN value > 10 THEN event_type ELSE event_type || '_v1' END AS collection, event_type || '_v1' AS physical,
  CASE WHEN value > 80 THEN 'small' WHEN value > 60 THEN 'unregistered' WHEN value > 40 THEN 'large' END AS asked FROM events),
rm AS (SELECT *, coalesce(asked, CASE WHEN collection = 'view' THEN 'large' END,
  CASE physical WHEN 'view_v1' THEN 'small' WHEN 'click_v1' THEN 'large' END, 'default') AS model FROM r)"""


@query("model_selection", f"WITH {MODEL_SQL} SELECT event_id, model FROM rm")
def model_selection(spark, sf_dir):
    return select_models(_model_requests(spark, sf_dir), CATALOG, "query").select("event_id", "model")


def _named_points(spark, sf_dir):
    """Points whose vectors sit under different names, by label."""
    label, v = F.col("label"), F.col("dense")
    return b.embedded(spark, sf_dir).select(
        "id", "label",
        F.when(label < 4, v).alias("summary"), F.when(label.between(2, 6), F.transform(v, lambda x: -x)).alias("title"),
    )


@query(
    "dense_of_named",
    """WITH n AS (SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label < 4 THEN embedding[1] END AS s, CASE WHEN label BETWEEN 2 AND 6 THEN -embedding[1] END AS t
  FROM embeddings)
SELECT id, s::DOUBLE AS by_name, coalesce(s, t)::DOUBLE AS first_dense, CASE WHEN (s IS NULL) <> (t IS NULL) THEN coalesce(s, t) END::DOUBLE AS only_one,
  CAST(NULL AS DOUBLE) AS unknown FROM n""",
)
def dense_of_named(spark, sf_dir):
    p, names = _named_points(spark, sf_dir), ["summary", "title"]

    def head(spec):
        return F.get(dense_of(p, spec, names), F.lit(0)).cast("double")

    return p.select(
        "id",
        head(CollectionSpec("a", 64, vector_name="summary")).alias("by_name"),
        head(CollectionSpec("b", 64, sparse_vector_name="terms")).alias("first_dense"),
        head(CollectionSpec("c", 64)).alias("only_one"),
        head(None).alias("unknown"),
    )


@query(
    "copy_vector",
    "SELECT CAST(vec_id AS VARCHAR) AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total, 64::BIGINT AS size FROM embeddings",
)
def copied_vector(spark, sf_dir):
    copied = copy_vector(b.embedded(spark, sf_dir), "dense", "summary")
    total = F.aggregate("summary", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return copied.select("id", F.round(total, 4).alias("total"), F.size("summary").cast("bigint").alias("size"))


@query(
    "default_ids",
    "SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN CAST(conv_id * 1000 + turn AS VARCHAR) END, md5('chat' || chr(1) || text)) AS id FROM conversations",
)
def default_ids(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations")
    given = F.when(F.col("role") == "user", (F.col("conv_id") * 1000 + F.col("turn")).cast("string"))
    return turns.select("conv_id", "turn", default_id("chat", F.col("text"), given).alias("id"))
