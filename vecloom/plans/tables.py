"""Queries that change, store and audit point tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from vecloom.operators import mutate
from vecloom.operators.audit import audit_shapes, collection_stats
from vecloom.operators.embed import HashEmbedder
from vecloom.plans import bindings as b
from vecloom.plans.registry import query
from vecloom.plans.text import POLICY, PREFIX_SQL
from vecloom.session import scratch_path
from vecloom.sources.tables import PointTable, migration_source, patch_payload_all, set_payload_all, write_all, write_checked
from vecloom.spec import CollectionSpec

DOC_SPEC = CollectionSpec(
    "docs_v1", 64, sparse_vector_name="sparse",
    payload_types=(("text", "string"), ("lang", "string"), ("source", "string"), ("quality", "bigint"),
                   ("text_raw", "string"), ("metadata_prefix", "string")),
    buckets=8,
)


def _relabelled(spark, sf_dir):
    """The documents somebody labelled, with the label as new payload and a new source."""
    labels = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"), F.col("quality").cast("bigint").alias("quality"))
    return b.texts(spark, sf_dir).join(labels, "id").withColumn("source", F.lit("labelled")).drop("n_chars")


UPSERTED_SQL = """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text, d.lang, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source,
  CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


@query("upsert_merge", UPSERTED_SQL)
def upsert_merge(spark, sf_dir):
    return mutate.upsert_points(b.texts(spark, sf_dir).drop("n_chars"), _relabelled(spark, sf_dir))


@query(
    "upsert_last_wins",
    """WITH last AS (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT CAST(coalesce(c_custkey, o_custkey) AS VARCHAR) AS id, CASE WHEN o_custkey IS NULL THEN c_mktsegment END AS segment, o_orderstatus AS status, o_orderpriority AS priority
FROM customer FULL OUTER JOIN last ON o_custkey = c_custkey""",
)
def upsert_last_wins(spark, sf_dir):
    """Customers as points; their orders as a batch in which an id comes many times."""
    target = b.table(spark, sf_dir, "customer").select(b.text_id("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    batch = b.table(spark, sf_dir, "orders").select(
        b.text_id("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderkey"
    )
    return mutate.upsert_points(target, batch, "o_orderkey")


@query(
    "payload_set",
    "SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.doc_id IS NULL THEN source ELSE 'reviewed' END AS source, l.doc_id IS NOT NULL AS reviewed_set,"
    " CASE WHEN l.doc_id IS NOT NULL THEN 'yes' END AS reviewed FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def payload_set(spark, sf_dir):
    ids = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"))
    done = mutate.payload_set(b.texts(spark, sf_dir), ids, {"source": "reviewed", "reviewed": "yes"})
    return done.select("id", "source", F.col("reviewed").isNotNull().alias("reviewed_set"), "reviewed")


@query(
    "payload_set_counts",
    "SELECT (SELECT count(*) FROM conversations) AS requested, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations)) AS matched",
)
def payload_set_counts(spark, sf_dir):
    ids = b.table(spark, sf_dir, "conversations").select(b.text_id("conv_id").alias("id"))
    return mutate.payload_set_counts(b.texts(spark, sf_dir), ids)


@query(
    "payload_patch",
    """WITH pa AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE value > 10) AS kind, arg_max(value, event_id) FILTER (WHERE event_type <> 'error') AS v FROM events GROUP BY user_id)
SELECT CAST(doc_id AS VARCHAR) AS id, lang, coalesce(kind, source) AS source, v AS value FROM documents LEFT JOIN pa ON user_id = doc_id""",
)
def payload_patch(spark, sf_dir):
    """Every event patches the document with its user's number; later ones win field by field."""
    patches = b.table(spark, sf_dir, "events").select(
        b.text_id("user_id").alias("id"), F.col("event_id").alias("ordinal"),
        F.when(F.col("value") > 10, F.col("event_type")).alias("source"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    done = mutate.payload_patch(b.texts(spark, sf_dir), patches, ["source", "value"])
    return done.select("id", "lang", "source", "value")


@query(
    "payload_map_merge",
    """SELECT CAST(d.doc_id AS VARCHAR) AS id, lang, CASE WHEN l.doc_id IS NULL THEN source ELSE 'merged' END AS source, CAST(quality AS VARCHAR) AS quality
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def payload_map_merge(spark, sf_dir):
    patch = b.table(spark, sf_dir, "labels").select(
        b.text_id("doc_id").alias("id"),
        F.create_map(F.lit("source"), F.lit("merged"), F.lit("quality"), F.col("quality").cast("string")).alias("patch"),
    )
    docs = b.texts(spark, sf_dir).select("id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("payload"))
    merged = docs.join(patch, "id", "left").select("id", mutate.merge_maps(F.col("payload"), F.col("patch")).alias("p"))
    return merged.select("id", *[F.try_element_at("p", F.lit(k)).alias(k) for k in ("lang", "source", "quality")])


@query("stored_upsert", UPSERTED_SQL)
def stored_upsert(spark, sf_dir):
    """Create a table, fill it, upsert into it, read it back."""
    table = PointTable(spark, scratch_path(spark, "stored"), DOC_SPEC)
    table.ensure()
    table.upsert(b.texts(spark, sf_dir))
    table.upsert(_relabelled(spark, sf_dir))
    return table.read().select("id", "text", "lang", "source", "quality")


@query("dual_write", "WITH tg AS (SELECT unnest(['docs_v1', 'docs_v2']) AS target) SELECT target, id, lang, source, quality FROM tg, (" + UPSERTED_SQL + ")")
def dual_write(spark, sf_dir):
    root = scratch_path(spark, "dual")
    two = [PointTable(spark, root, DOC_SPEC), PointTable(spark, root, CollectionSpec(**{**DOC_SPEC.__dict__, "name": "docs_v2", "buckets": 4}))]
    for t in two:
        t.ensure()
    write_all(b.texts(spark, sf_dir), two)
    write_all(_relabelled(spark, sf_dir), two)
    columns = ["id", "lang", "source", "quality"]
    first, second = (t.read().select(F.lit(t.spec.name).alias("target"), *columns) for t in two)
    return first.unionByName(second)


CARDS = [
    CollectionSpec("cards_v1", 64, payload_types=(("label", "bigint"),), buckets=4),
    CollectionSpec("cards_v2", 64, vector_name="summary", sparse_vector_name="words", payload_types=(("label", "bigint"),), buckets=8),
]


@query(
    "dual_write_named",
    """SELECT target, CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, pos,
  CASE WHEN vec_id % 3 = 0 THEN -embedding[pos]::DOUBLE ELSE embedding[pos]::DOUBLE END AS value
FROM embeddings, (SELECT unnest(['cards_v1', 'cards_v2']) AS target), (SELECT unnest(range(1, 65)) AS pos)""",
)
def dual_write_named(spark, sf_dir):
    """One vector without a name goes to two tables, one of which names it; a second batch turns a third of the vectors round."""
    root = scratch_path(spark, "named")
    tables = [PointTable(spark, root, spec) for spec in CARDS]
    for t in tables:
        t.ensure()
    points = b.embedded(spark, sf_dir)
    write_all(points, tables)
    turned = points.filter(F.col("id").cast("bigint") % 3 == 0)
    write_all(turned.withColumns({"dense": F.transform("dense", lambda x: -x), "label": F.col("label") + 100}), tables)
    both = [t.read().select(F.lit(t.spec.name).alias("target"), "id", "label", F.col(t.spec.dense_column).alias("v")) for t in tables]
    each = both[0].unionByName(both[1]).select("target", "id", "label", F.posexplode("v").alias("pos", "value"))
    return each.select("target", "id", "label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


@query(
    "upsert_rejects",
    """WITH p AS (SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label = 0 THEN NULL WHEN label = 1 THEN embedding[:32] ELSE embedding END AS v FROM embeddings)
SELECT 'rejected' AS target, id, 0::BIGINT AS pos, 0.0::DOUBLE AS value,
  CASE WHEN v IS NULL THEN 'Collection ''cards_v1'' requires a dense vector payload for upsert'
    ELSE 'Collection ''cards_v1'' expects dense vector size 64, got ' || len(v) END AS reason FROM p WHERE v IS NULL OR len(v) <> 64
UNION ALL
SELECT target, id, pos, v[pos]::DOUBLE, NULL FROM p, (SELECT unnest(['cards_v1', 'cards_v2']) AS target), (SELECT unnest(range(1, 65)) AS pos) WHERE len(v) = 64""",
)
def upsert_rejects(spark, sf_dir):
    """Points without a vector, or with one of another size, are written nowhere and come back with the reason."""
    root = scratch_path(spark, "rejects")
    tables = [PointTable(spark, root, spec) for spec in CARDS]
    for t in tables:
        t.ensure()
    dense = F.when(F.col("label") == 1, F.slice("dense", 1, 32)).when(F.col("label") != 0, F.col("dense"))
    _, rejected = write_checked(b.embedded(spark, sf_dir).withColumn("dense", dense), tables)
    bad = rejected.select(F.lit("rejected").alias("target"), "id", F.lit(0).cast("bigint").alias("pos"), F.lit(0.0).alias("value"), "reason")
    both = [t.read().select(F.lit(t.spec.name).alias("target"), "id", F.col(t.spec.dense_column).alias("v")) for t in tables]
    each = both[0].unionByName(both[1]).select("target", "id", F.posexplode("v").alias("pos", "value"))
    good = each.select("target", "id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))
    return bad.unionByName(good)


@query(
    "payload_all_targets",
    """WITH pa AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE value > 10) AS kind, arg_max(value, event_id) FILTER (WHERE event_type <> 'error') AS v,
  max(event_id) FILTER (WHERE event_type = 'error') AS cleared, max(event_id) FILTER (WHERE event_type <> 'error') AS valued FROM events GROUP BY user_id),
d AS (SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN lang END AS lang, CASE WHEN l.doc_id IS NULL THEN source ELSE 'reviewed' END AS source, l.doc_id IS NOT NULL AS reviewed
  FROM documents LEFT JOIN labels l USING (doc_id))
SELECT target, CAST(doc_id AS VARCHAR) AS id, lang, coalesce(kind, source) AS source, CASE WHEN reviewed THEN 'yes' END AS reviewed,
  CASE WHEN coalesce(cleared > valued, cleared IS NOT NULL) THEN NULL ELSE v END AS value
FROM d LEFT JOIN pa ON user_id = doc_id, (SELECT unnest(['docs_v1', 'docs_v2']) AS target)""",
)
def payload_all_targets(spark, sf_dir):
    """Stored tables: the labelled documents are marked in two targets, then every event patches its user's document or clears a field."""
    root = scratch_path(spark, "payload")
    two = [PointTable(spark, root, replace(DOC_SPEC, sparse_vector_name=None)), PointTable(spark, root, replace(DOC_SPEC, name="docs_v2", sparse_vector_name=None, payload_types=(("lang", "string"),)))]
    for t in two:
        t.ensure()
        t.load(b.texts(spark, sf_dir).select("id", "lang", "source"))
    labelled = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"))
    set_payload_all(two, labelled, {"source": "reviewed", "reviewed": "yes", "lang": None})
    error = F.col("event_type") == "error"
    patches = b.table(spark, sf_dir, "events").select(
        b.text_id("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.when(F.col("value") > 10, F.col("event_type")).alias("source"),
        F.when(~error, F.col("value")).alias("value"), F.when(error, F.array(F.lit("value"))).alias("cleared"),
    )
    patch_payload_all(two, patches, ["source", "value"], clear="cleared")

    def out(t):
        rows = t.read()
        json = {f: F.get_json_object("extra", f"$.{f}") for f in ("source", "reviewed", "value")}
        source = F.col("source") if "source" in rows.columns else json["source"]
        return rows.select(F.lit(t.spec.name).alias("target"), "id", "lang", source.alias("source"), json["reviewed"].alias("reviewed"), json["value"].cast("double").alias("value"))

    return out(two[0]).unionByName(out(two[1]))


@query(
    "retrieve_stored",
    "SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
)
def retrieve_stored(spark, sf_dir):
    """A stored table answers for ids: only the buckets they fall into are read."""
    table = PointTable(spark, scratch_path(spark, "retrieve"), DOC_SPEC)
    table.ensure()
    table.load(b.texts(spark, sf_dir))
    ids = b.table(spark, sf_dir, "benchmark").select(b.text_id("item_id").alias("id"))
    return table.retrieve(ids).select("id", "text", "lang", "source")


@query(
    "stored_statistics",
    f"""WITH d AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN quality = 0 THEN 'gone' WHEN quality = 1 THEN text || ' seen' ELSE text END AS text FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
{b.terms_sql('p', 'id', 'd')}
SELECT index, count(*) AS df, (SELECT count(DISTINCT id) FROM p) AS n FROM p GROUP BY index""",
)
def stored_statistics(spark, sf_dir):
    """Term counts that follow the upserts: texts are replaced by others, and replaced again by the same."""
    table = PointTable(spark, scratch_path(spark, "statistics"), CollectionSpec(**{**DOC_SPEC.__dict__, "sparse_modifier": "idf"}))
    table.ensure()
    docs = b.texts(spark, sf_dir).select("id", "text")
    table.load(docs)
    labels = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"), "quality")
    changed = docs.join(labels, "id").select(
        "id", F.when(F.col("quality") == 0, "gone").when(F.col("quality") == 1, F.concat("text", F.lit(" seen"))).otherwise(F.col("text")).alias("text")
    )
    table.upsert(changed)
    # Nothing reads the table as it was loaded any more.
    table.expire()
    table.upsert(changed)
    return table.statistics()


@query(
    "table_lifecycle",
    "SELECT 'docs_v1' AS name, true AS created, false AS created_again, true AS alias_set, false AS alias_of_own_name, count(*) AS points FROM documents",
)
def table_lifecycle(spark, sf_dir):
    table = PointTable(spark, scratch_path(spark, "life"), DOC_SPEC)
    created, again = table.ensure(), table.ensure()
    table.upsert(b.texts(spark, sf_dir))
    alias, own = table.repoint("docs_current"), table.repoint("docs_v1")
    return spark.table("docs_current").agg(F.count("*").alias("points")).select(
        F.lit("docs_v1").alias("name"), F.lit(created).alias("created"), F.lit(again).alias("created_again"),
        F.lit(alias).alias("alias_set"), F.lit(own).alias("alias_of_own_name"), "points",
    )


@query(
    "upsert_chunks",
    f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, NULL::INT AS quality, NULL::BOOLEAN AS toxic FROM documents),
p AS (SELECT *, {PREFIX_SQL} || E'\\n' || text AS full_text FROM d WHERE trim(text, E' \\n\\t') <> ''),
tk AS (SELECT id, ('0x' || substr(md5(lower(unnest(regexp_extract_all(full_text, '[\\p{{L}}\\p{{N}}_]+')))), 1, 8))::BIGINT % 2147483647 AS index FROM p),
n AS (SELECT id, count(DISTINCT index) AS n_terms FROM tk GROUP BY id)
SELECT p.id, full_text AS text, text AS text_raw, n_terms, 64::BIGINT AS vector_size FROM p JOIN n USING (id)""",
)
def upsert_chunks(spark, sf_dir):
    """Documents as chunks: validate, prefix, embed, hash terms, store, read back."""
    chunks = b.texts(spark, sf_dir).select(
        "id", F.col("text").alias("chunk_text"), F.lit(None).cast("array<float>").alias("vector"), "lang", "source"
    )
    points, _ = mutate.prepare_chunks(chunks, DOC_SPEC.name, HashEmbedder(64), POLICY)
    table = PointTable(spark, scratch_path(spark, "chunks"), DOC_SPEC)
    table.ensure()
    table.upsert(points)
    return table.read().select(
        "id", "text", "text_raw", F.size("sparse.indices").cast("bigint").alias("n_terms"), F.size("dense").cast("bigint").alias("vector_size")
    )


# --- shape and size -------------------------------------------------------------------------------------


def _tables(spark, sf_dir):
    points = b.embedded(spark, sf_dir)
    terms = F.struct(F.array("label").alias("indices"), F.array(F.lit(1.0)).alias("values"))
    return {
        "plain": points,
        "named": points.withColumnRenamed("dense", "summary").withColumn("sparse", terms),
        "mixed": points.withColumn("dense", F.when(F.col("label") < 5, F.slice("dense", 1, 32)).otherwise(F.col("dense"))),
        "empty": points.filter(F.lit(False)),
        "texts": b.texts(spark, sf_dir),
    }


STATS_SQL = """
st AS (
  SELECT 'plain' AS name, 'dense' AS vector_name, NULL AS sparse_vector_name, count(*) AS points_count, count(*) AS vectors_count, 64::BIGINT AS min_size, 64::BIGINT AS max_size FROM embeddings
  UNION ALL SELECT 'named', 'summary', 'sparse', count(*), count(*), 64, 64 FROM embeddings
  UNION ALL SELECT 'mixed', 'dense', NULL, count(*), count(*), min(CASE WHEN label < 5 THEN 32 ELSE 64 END), max(CASE WHEN label < 5 THEN 32 ELSE 64 END) FROM embeddings
  UNION ALL SELECT 'empty', 'dense', NULL, 0, 0, NULL, NULL
  UNION ALL SELECT 'texts', NULL, NULL, count(*), 0, NULL, NULL FROM documents
)"""


@query(
    "collection_stats",
    f"WITH {STATS_SQL} SELECT *, 'ok' AS status FROM st UNION ALL SELECT 'gone', NULL, NULL, NULL, NULL, NULL, NULL, 'error: no such table'",
)
def stats_of_tables(spark, sf_dir):
    return collection_stats(spark, {**_tables(spark, sf_dir), "gone": FileNotFoundError("no such table")})


@query(
    "shape_audit",
    f"""WITH {STATS_SQL}, want AS (SELECT * FROM (VALUES ('plain', NULL, 64, NULL), ('named', 'summary', 64, 'sparse'), ('mixed', NULL, 64, NULL),
  ('empty', NULL, 64, 'sparse'), ('texts', 'dense', 64, NULL), ('absent', NULL, 8, NULL)) AS t(name, want_vector, want_size, want_sparse))
SELECT w.name, want_vector, want_size::BIGINT AS want_size, want_sparse, vector_name, min_size, max_size, sparse_vector_name, points_count,
  CASE w.name WHEN 'plain' THEN 'ok' WHEN 'named' THEN 'ok' WHEN 'mixed' THEN 'warn' WHEN 'empty' THEN 'recreate' WHEN 'texts' THEN 'warn' ELSE 'create' END AS action
FROM want w LEFT JOIN st USING (name)""",
)
def shape_audit(spark, sf_dir):
    specs = [
        CollectionSpec("plain", 64), CollectionSpec("named", 64, vector_name="summary", sparse_vector_name="sparse"),
        CollectionSpec("mixed", 64), CollectionSpec("empty", 64, sparse_vector_name="sparse"),
        CollectionSpec("texts", 64, vector_name="dense"), CollectionSpec("absent", 8),
    ]
    return audit_shapes(spark, specs, collection_stats(spark, _tables(spark, sf_dir)))


@query(
    "migration_source",
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang, source FROM documents WHERE n_chars > 500 AND source IN ('src1', 'src3', 'src5')",
)
def slice_source(spark, sf_dir):
    rows = migration_source(
        b.texts(spark, sf_dir), {"must": [{"key": "n_chars", "range": {"gt": 500}}]}, "source", ["src1", "src3", "src5"]
    )
    return rows.select("id", "lang", "source")
