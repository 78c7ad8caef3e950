"""Queries over the migration event log and the migration queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.functions.text import sparse_terms
from vecloom.operators import migration as m
from vecloom.operators import resume
from vecloom.operators.digests import compare_tables
from vecloom.operators import queue as mq
from vecloom.operators.audit import collection_stats
from vecloom.operators.embed import HashEmbedder, embed_texts
from vecloom.operators.mutate import copy_vector
from vecloom.plans import bindings as b
from vecloom.plans.registry import query
from vecloom.session import scratch_path, written
from vecloom.sources.aliases import read_aliases, sync_aliases
from vecloom.sources.events import append_events, read_events
from vecloom.sources.tables import PointTable, migration_source
from vecloom.spec import CollectionSpec


def joined(column: str):
    return F.array_join(column, ",").alias(column)


@query("migration_state", f"WITH {b.EVENTS_SQL}, {b.STATES_SQL} SELECT * FROM states")
def migration_state(spark, sf_dir):
    states = m.current_state(b.migration_events(spark, sf_dir))
    return states.withColumn("write_targets", joined("write_targets"))


@query("migration_state_compacted", f"WITH {b.EVENTS_SQL}, {b.STATES_SQL} SELECT * FROM states")
def migration_state_compacted(spark, sf_dir):
    """The same state from the compacted log."""
    states = m.current_state(m.compact(b.migration_events(spark, sf_dir)))
    return states.withColumn("write_targets", joined("write_targets"))


@query(
    "events_recent",
    f"WITH {b.EVENTS_SQL} SELECT event_id, logical_name, event, state, task_id, note, metadata, created_at FROM ev"
    " QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id DESC) <= 20",
)
def events_recent(spark, sf_dir):
    return m.recent_events(b.migration_events(spark, sf_dir)).select(
        "event_id", "logical_name", "event", "state", "task_id", "note", "metadata", "created_at"
    )


@query(
    "events_appended",
    f"WITH {b.EVENTS_SQL} SELECT event, count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(task_id) AS tasks FROM ev GROUP BY event",
)
def events_appended(spark, sf_dir):
    path = scratch_path(spark, "events")
    events = b.migration_events(spark, sf_dir)
    append_events(events.filter("event = 'bootstrap'"), path)
    append_events(events.filter("event <> 'bootstrap'"), path)
    return read_events(spark, path).groupBy("event").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("task_id").alias("tasks")
    )


# --- phases ---------------------------------------------------------------------------------------------


def _actions(spark, sf_dir):
    """Every request of the log asks for a phase change of its user's collection."""
    kind, value, k = F.col("event_type"), F.col("value"), b.json_k()
    action = (
        F.when(kind == "view", F.when(value > 60, "archive").otherwise("prepare")).when(kind == "click", "dual-write")
        .when(kind == "signup", "backfill").when(kind == "purchase", "cutover").otherwise(F.when(value > 20, "verify").otherwise("rollback"))
    )
    return b.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("logical_name"), action.alias("action"),
        F.when(k > 30, F.concat(F.lit("task-"), k.cast("string"))).alias("task_id"), F.lit(None).cast("string").alias("note"),
        F.when(k > 50, "ok").alias("result"), F.lit("{}").alias("metadata"), F.lit("2024-01-01").alias("created_at"),
    )


def _configured(spark, sf_dir):
    """Customers are the configured collections; their nation decides whether they have a next target."""
    key = F.col("c_custkey").cast("string")
    return b.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), key).alias("logical_name"), F.when(F.col("c_nationkey") > 5, F.concat(F.lit("v2_"), key)).alias("next_target")
    )


ACTIONS_SQL = """
a AS (SELECT event_id, 'u' || user_id AS logical_name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'view' THEN CASE WHEN value > 60 THEN 'archive' ELSE 'prepare' END WHEN 'click' THEN 'dual_write' WHEN 'signup' THEN 'backfill'
    WHEN 'purchase' THEN 'cutover' ELSE CASE WHEN value > 20 THEN 'verify' ELSE 'rollback' END END AS event,
  c_custkey IS NOT NULL AS known, CASE WHEN c_nationkey > 5 THEN 'v2_' || c_custkey END AS next
  FROM events LEFT JOIN customer ON c_custkey = user_id),
ar AS (SELECT *, CASE WHEN NOT known THEN 'Unknown logical collection: ' || logical_name WHEN event = 'archive' THEN 'Unsupported migration action: archive'
  WHEN event IN ('prepare', 'dual_write', 'cutover') AND next IS NULL THEN 'Logical collection ''' || logical_name || ''' has no configured next_target' END AS reason FROM a)"""


@query(
    "phase_events",
    f"""WITH {ACTIONS_SQL} SELECT event_id, logical_name, event, CASE event WHEN 'cutover' THEN 'live' ELSE event END AS state,
  CASE WHEN event IN ('prepare', 'dual_write', 'cutover') THEN next END AS next_target,
  CASE WHEN event IN ('prepare', 'dual_write', 'backfill') AND k > 30 THEN 'task-' || k END AS task_id,
  CASE WHEN event = 'verify' THEN CASE WHEN k > 50 THEN 'ok' ELSE 'pending' END END AS result FROM ar WHERE reason IS NULL""",
)
def phase_events(spark, sf_dir):
    events, _ = m.phase_events(_actions(spark, sf_dir), _configured(spark, sf_dir))
    return events.select("event_id", "logical_name", "event", "state", "next_target", "task_id", "result")


@query("phase_rejects", f"WITH {ACTIONS_SQL} SELECT event_id, logical_name, event, reason FROM ar WHERE reason IS NOT NULL")
def phase_rejects(spark, sf_dir):
    return m.phase_events(_actions(spark, sf_dir), _configured(spark, sf_dir))[1]


# --- routing --------------------------------------------------------------------------------------------


@query(
    "routing_current",
    f"""WITH {b.EVENTS_SQL}, {b.STATES_SQL}, r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'physical_' ELSE 'u' END || o_custkey AS collection FROM orders)
SELECT o_orderkey, collection, CASE WHEN collection LIKE 'u%' THEN read_target ELSE collection END AS read_target,
  CASE WHEN collection LIKE 'u%' THEN write_targets ELSE collection END AS write_targets,
  CASE WHEN collection LIKE 'u%' AND s.logical_name IS NULL THEN 'Unknown logical collection state: ' || collection END AS reason
FROM r LEFT JOIN states s ON s.logical_name = collection""",
)
def routing_current(spark, sf_dir):
    """Orders as requests: some name a logical collection, some a physical one."""
    requests = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.when(F.col("o_orderstatus") == "F", "physical_").otherwise("u"), F.col("o_custkey").cast("string")).alias("collection")
    )
    logical = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("logical_name"))
    states = m.current_state(b.migration_events(spark, sf_dir))
    return m.resolve_targets(requests, states, logical).withColumn("write_targets", joined("write_targets")).select(
        "o_orderkey", "collection", "read_target", "write_targets", "reason"
    )


@query(
    "routing_as_of",
    f"""WITH {b.EVENTS_SQL},
st AS (
  SELECT event_id, logical_name, event, state, next_target,
    CASE WHEN event = 'rollback' THEN 'v1_' || substr(logical_name, 2) WHEN event = 'cutover' THEN next_target ELSE read_target END AS rt,
    CASE WHEN event = 'rollback' THEN ['v1_' || substr(logical_name, 2)] WHEN event = 'cutover' THEN [next_target] ELSE write_targets END AS wt,
    CASE WHEN event IN ('bootstrap', 'bootstrap_sync', 'cutover', 'rollback') THEN event_id END AS bid
  FROM ev
),
rf AS (
  SELECT *, last_value(rt IGNORE NULLS) OVER w AS read_target, last_value(wt IGNORE NULLS) OVER w AS base_writes, last_value(bid IGNORE NULLS) OVER w AS base_id
  FROM st WINDOW w AS (PARTITION BY logical_name ORDER BY event_id ROWS UNBOUNDED PRECEDING)
),
du AS (SELECT logical_name, base_id, next_target, min(event_id) AS first FROM rf WHERE event = 'dual_write' AND NOT list_contains(base_writes, next_target) GROUP BY ALL),
ad AS (SELECT rf.event_id, string_agg(du.next_target, ',' ORDER BY du.first) AS added FROM rf JOIN du ON du.logical_name = rf.logical_name AND du.base_id = rf.base_id
  AND du.first <= rf.event_id GROUP BY rf.event_id)
SELECT rf.event_id AS at, logical_name, state, read_target, concat_ws(',', array_to_string(base_writes, ','), added) AS write_targets
FROM rf LEFT JOIN ad ON ad.event_id = rf.event_id WHERE rf.event_id >= 0""",
)
def routing_as_of(spark, sf_dir):
    """Where each event's own user was routed at that moment."""
    requests = b.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("logical_name"), F.col("event_id").alias("at")
    )
    found = m.routing_as_of(requests, b.migration_events(spark, sf_dir))
    return found.withColumn("write_targets", joined("write_targets"))


@query(
    "idle_drift",
    f"""WITH {b.EVENTS_SQL}, {b.STATES_SQL}, cfg AS (SELECT 'u' || c_custkey AS logical_name, CASE WHEN c_nationkey < 5 THEN 'v2' ELSE 'v1_' || c_custkey END AS r FROM customer)
SELECT cfg.logical_name, CASE WHEN s.logical_name IS NULL THEN 'bootstrap' ELSE 'bootstrap_sync' END AS event, r AS read_target, r || ',v2' AS write_targets,
  CASE WHEN s.logical_name IS NULL THEN r ELSE rollback_target END AS rollback_target, CASE WHEN s.logical_name IS NOT NULL THEN 'Aligned idle logical collection with config defaults' END AS note
FROM cfg LEFT JOIN states s USING (logical_name)
WHERE s.logical_name IS NULL OR (s.state = 'idle' AND (s.read_target IS DISTINCT FROM r OR s.write_targets IS DISTINCT FROM r || ',v2'))""",
)
def idle_drift(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    first = F.when(F.col("c_nationkey") < 5, "v2").otherwise(F.concat(F.lit("v1_"), key))
    logical = b.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), key).alias("logical_name"), F.array(first).alias("read_targets"), F.array(first, F.lit("v2")).alias("write_targets")
    )
    made = m.bootstrap_events(logical, m.current_state(b.migration_events(spark, sf_dir)))
    return made.withColumn("write_targets", joined("write_targets")).drop("state")


@query(
    "cutover_rollback",
    f"WITH {b.EVENTS_SQL}, {b.STATES_SQL} SELECT state, read_target, count(*) AS n FROM states WHERE state IN ('live', 'rollback') GROUP BY ALL",
)
def cutover_rollback(spark, sf_dir):
    states = m.current_state(b.migration_events(spark, sf_dir)).filter(F.col("state").isin("live", "rollback"))
    return states.groupBy("state", "read_target").agg(F.count("*").alias("n"))


@query("alias_targets", f"WITH {b.EVENTS_SQL}, {b.STATES_SQL} SELECT logical_name || '_now' AS alias, read_target FROM states WHERE state IN ('live', 'rollback')")
def alias_targets(spark, sf_dir):
    """Aliases that last: set from the states of the collections that were cut over or rolled back, read back from where they are kept."""
    root = scratch_path(spark, "aliases")
    states = m.current_state(b.migration_events(spark, sf_dir)).filter(F.col("state").isin("live", "rollback"))
    states = written(states.select("logical_name", "read_target"), "states")
    # The configured collections.
    names = states.select("logical_name", F.concat(F.coalesce("logical_name", F.lit("None")), F.lit("_now")).alias("alias"))
    sync_aliases(spark, root, states, names)
    return names.select("alias").join(read_aliases(spark, root).withColumnRenamed("table", "read_target"), "alias", "left")


@query(
    "logical_info",
    f"""WITH {b.EVENTS_SQL}, {b.STATES_SQL},
re AS (SELECT logical_name, string_agg(event_id || ':' || event, ' ' ORDER BY event_id DESC) AS recent FROM
  (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id DESC) <= 10) GROUP BY logical_name)
SELECT s.logical_name, 'hybrid' AS default_query_mode, state, read_target, write_targets, CASE WHEN read_target IN ('v2', 'v3', 'v4') THEN (SELECT count(*) FROM documents) END AS read_points, recent
FROM states s JOIN re USING (logical_name)""",
)
def logical_info(spark, sf_dir):
    events = b.migration_events(spark, sf_dir)
    states = m.current_state(events)
    logical = states.select(
        "logical_name", F.lit("hybrid").alias("default_query_mode"), F.lit("v2").alias("next_target"), F.array().cast("array<string>").alias("read_targets")
    )
    docs = b.texts(spark, sf_dir)
    stats = collection_stats(spark, {"v2": docs, "v3": docs, "v4": docs})
    info = m.logical_info(logical, states, stats, events)
    recent = F.transform("recent_events", lambda e: F.concat_ws(":", e.getField("event_id").cast("string"), e.getField("event")))
    return info.select(
        "logical_name", "default_query_mode", "state", "read_target", joined("write_targets"), "read_points", F.array_join(recent, " ").alias("recent")
    )


# --- backfill -------------------------------------------------------------------------------------------

TARGET_SPEC = CollectionSpec(
    "docs_v2", 64, vector_name="summary", sparse_vector_name="sparse", payload_types=(("text", "string"), ("lang", "string"), ("source", "string")), buckets=8
)


@query(
    "backfill_slices",
    "SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')",
)
def backfill_slices(spark, sf_dir):
    """Two slices of the source, each backfilled on its own; the second is run twice, as after a failure."""
    docs = b.texts(spark, sf_dir)
    target = PointTable(spark, scratch_path(spark, "backfill"), TARGET_SPEC)
    target.ensure()
    for shards in (["src0", "src1"], ["src2", "src3"], ["src2", "src3"]):
        target.upsert(migration_source(docs, None, "source", shards))
    return target.read().select("id", "text", "lang", "source")


@query(
    "reembed_backfill",
    """WITH d AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding, text FROM embeddings JOIN documents ON doc_id = vec_id),
t AS (SELECT id, count(DISTINCT ('0x' || substr(md5(w), 1, 8))::BIGINT % 2147483647) AS n_terms FROM
  (SELECT id, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS w FROM d) GROUP BY id)
SELECT d.id, round(list_sum(embedding::DOUBLE[]), 4) AS copied_total, coalesce(n_terms, 0) AS n_terms, 64::BIGINT AS new_size FROM d LEFT JOIN t USING (id)""",
)
def reembed_backfill(spark, sf_dir):
    """Old vectors kept under their new name, texts embedded again, terms made, written to the next table."""
    source = b.embedded(spark, sf_dir).join(b.texts(spark, sf_dir), "id").drop("label", "n_chars")
    moved = copy_vector(source, "dense", "summary").withColumn("sparse", sparse_terms(F.col("text")))
    moved = embed_texts(moved, "text", HashEmbedder(64), into="again")
    spec = CollectionSpec(
        "docs_v3", 64, vector_name="summary", sparse_vector_name="sparse", payload_types=(("again", "array<float>"), ("text", "string")), buckets=8
    )
    target = PointTable(spark, scratch_path(spark, "reembed"), spec)
    target.ensure()
    target.upsert(moved)
    total = F.aggregate("summary", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return target.read().select(
        "id", F.round(total, 4).alias("copied_total"), F.size("sparse.indices").cast("bigint").alias("n_terms"), F.size("again").cast("bigint").alias("new_size")
    )


@query(
    "backfill_verify",
    """WITH t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang, text, source FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT page_id + 1000000000, 'en', url, 'web' FROM pages)
SELECT coalesce(s.source, t.source) AS source, count(s.doc_id) AS source_count, count(t.doc_id) AS target_count, count(*) FILTER (WHERE t.doc_id IS NULL) AS missing,
  count(*) FILTER (WHERE s.doc_id IS NULL) AS extra, count(*) FILTER (WHERE s.lang <> t.lang) AS differing,
  CASE WHEN count(*) FILTER (WHERE t.doc_id IS NULL OR s.doc_id IS NULL OR s.lang <> t.lang) = 0 THEN 'ok' ELSE 'mismatch' END AS result
FROM documents s FULL OUTER JOIN t ON t.doc_id = s.doc_id GROUP BY 1""",
)
def backfill_verify(spark, sf_dir):
    """The target has only the labelled documents, the toxic ones altered, and pages nobody asked for."""
    source = b.texts(spark, sf_dir).select("id", "text", "lang", "source")
    labels = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"), "toxic")
    copied = source.join(labels, "id").withColumn("lang", F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang"))).drop("toxic")
    pages = b.table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1_000_000_000).cast("string").alias("id"), F.col("url").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")
    )
    return m.verify_backfill(source, copied.unionByName(pages), "source", ["text", "lang"])


VERIFY_SQL = """t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang, text, source FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT page_id + 1000000000, 'en', url, 'web' FROM pages)"""


def _compared(spark, sf_dir):
    """The same source and target as ``backfill_verify``, with ranges small enough that most of them agree."""
    source = b.texts(spark, sf_dir).select("id", "text", "lang", "source")
    labels = b.table(spark, sf_dir, "labels").select(b.text_id("doc_id").alias("id"), "toxic")
    copied = source.join(labels, "id").withColumn("lang", F.when(F.col("toxic") == 1, "xx").otherwise(F.col("lang"))).drop("toxic")
    pages = b.table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1_000_000_000).cast("string").alias("id"), F.col("url").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")
    )
    return compare_tables(source, copied.unionByName(pages), "source", ["text", "lang"])


@query(
    "digest_verify",
    f"""WITH {VERIFY_SQL}
SELECT coalesce(s.source, t.source) AS source, count(s.doc_id) AS source_count, count(t.doc_id) AS target_count, count(*) FILTER (WHERE t.doc_id IS NULL) AS missing,
  count(*) FILTER (WHERE s.doc_id IS NULL) AS extra, count(*) FILTER (WHERE s.lang <> t.lang) AS differing,
  CASE WHEN count(*) FILTER (WHERE t.doc_id IS NULL OR s.doc_id IS NULL OR s.lang <> t.lang) = 0 THEN 'ok' ELSE 'mismatch' END AS result
FROM documents s FULL OUTER JOIN t ON t.doc_id = s.doc_id GROUP BY 1""",
)
def digest_verify(spark, sf_dir):
    return _compared(spark, sf_dir).report


@query(
    "digest_differences",
    f"""WITH {VERIFY_SQL}
SELECT CAST(coalesce(s.doc_id, t.doc_id) AS VARCHAR) AS id, coalesce(s.source, t.source) AS source,
  CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'extra' ELSE 'differing' END AS kind,
  s.lang AS source_lang, t.lang AS target_lang, s.text AS source_text, t.text AS target_text
FROM documents s FULL OUTER JOIN t ON t.doc_id = s.doc_id WHERE t.doc_id IS NULL OR s.doc_id IS NULL OR s.lang <> t.lang""",
)
def digest_differences(spark, sf_dir):
    """Every row that differs, with both values."""
    found = _compared(spark, sf_dir).differences
    return found.select(
        "id", F.col("partition").alias("source"), "kind", F.col("source.lang").alias("source_lang"), F.col("target.lang").alias("target_lang"),
        F.col("source.text").alias("source_text"), F.col("target.text").alias("target_text"),
    )


def _slices(spark, sf_dir):
    """Orders are slices of their customer's collection: ids between the order's key and a length that its price gives."""
    start = F.col("o_orderkey") % 5000
    end = start + 1 + (F.col("o_totalprice") % 900).cast("bigint")
    return b.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 20).cast("string")).alias("logical_name"),
        F.when(start >= 40, F.lpad(start.cast("string"), 6, "0")).alias("after_id"), F.lpad(end.cast("string"), 6, "0").alias("last_id"),
    )


SLICES_SQL = """
sl AS (
  SELECT 'u' || (o_custkey % 20) AS logical_name, CASE WHEN o_orderkey % 5000 >= 40 THEN lpad((o_orderkey % 5000)::VARCHAR, 6, '0') END AS after_id,
    lpad((o_orderkey % 5000 + 1 + floor(o_totalprice % 900)::BIGINT)::VARCHAR, 6, '0') AS last_id FROM orders
),
reach AS (
  SELECT *, max(last_id) OVER (PARTITION BY logical_name ORDER BY after_id NULLS FIRST, last_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM sl
),
open_ranges AS (
  SELECT logical_name, reached AS after_id, after_id AS until_id FROM reach WHERE after_id IS NOT NULL AND coalesce(after_id > reached, true)
  UNION ALL SELECT logical_name, max(last_id), NULL FROM sl GROUP BY logical_name
)"""


@query("open_ranges", f"WITH {SLICES_SQL} SELECT * FROM open_ranges")
def open_ranges_of_slices(spark, sf_dir):
    """What slices that ended in any order have left open."""
    return resume.open_ranges(_slices(spark, sf_dir))


@query(
    "resume_open_rows",
    f"""WITH {SLICES_SQL}, rows AS (SELECT event_id, 'u' || (user_id % 25) AS logical_name, lpad((event_id % 7000)::VARCHAR, 6, '0') AS id FROM events)
SELECT event_id, logical_name, id FROM rows r WHERE logical_name NOT IN (SELECT logical_name FROM open_ranges)
  OR EXISTS (SELECT 1 FROM open_ranges o WHERE o.logical_name = r.logical_name AND (after_id IS NULL OR r.id > after_id) AND (until_id IS NULL OR r.id <= until_id))""",
)
def resume_open_rows(spark, sf_dir):
    """Rows no finished slice covers; some collections have no slice at all."""
    rows = b.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string")).alias("logical_name"), F.lpad((F.col("event_id") % 7000).cast("string"), 6, "0").alias("id")
    )
    return resume.open_rows(rows, resume.open_ranges(_slices(spark, sf_dir)), F.col("logical_name"))


@query(
    "resume_after_checkpoint",
    f"""WITH {b.EVENTS_SQL}, cp AS (SELECT logical_name, json_extract_string(metadata, '$.checkpoint.last_id') AS last_id FROM ev
  WHERE json_extract_string(metadata, '$.checkpoint.last_id') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id DESC) = 1)
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'u' || o_custkey AS logical_name FROM orders LEFT JOIN cp ON logical_name = 'u' || o_custkey
WHERE last_id IS NULL OR CAST(o_orderkey AS VARCHAR) > last_id""",
)
def resume_after_checkpoint(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select(
        b.text_id("o_orderkey").alias("id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("logical_name")
    )
    return m.after_checkpoint(rows, b.migration_events(spark, sf_dir), F.col("logical_name"))


# --- queue ----------------------------------------------------------------------------------------------

NOON = "12:00"


def _reconciled(spark, sf_dir):
    return mq.reconcile(b.queue_items(spark, sf_dir), b.migration_events(spark, sf_dir), b.tasks(spark, sf_dir))


@query(
    "queue_reconcile",
    f"WITH {b.EVENTS_SQL}, {b.QUEUE_SQL} SELECT id, status, task_id, task_status, last_error FROM synced",
)
def queue_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("id", "status", "task_id", "task_status", "last_error")


@query(
    "queue_due",
    f"WITH {b.EVENTS_SQL}, {b.QUEUE_SQL} SELECT id, status FROM synced WHERE status <> 'completed' AND w_start <= 720 AND 720 < w_stop",
)
def queue_due(spark, sf_dir):
    return mq.due(_reconciled(spark, sf_dir), NOON).select("id", "status")


@query(
    "queue_pause",
    f"WITH {b.EVENTS_SQL}, {b.QUEUE_SQL} SELECT id, task_id FROM synced WHERE status = 'running' AND task_status = 'running' AND 720 >= w_pause",
)
def queue_pause(spark, sf_dir):
    return mq.to_pause(_reconciled(spark, sf_dir), NOON).select("id", "task_id")


@query(
    "queue_next_action",
    f"WITH {b.EVENTS_SQL}, {b.QUEUE_SQL}, {b.NEXT_ACTION_SQL} SELECT id, status, task_status, next_action FROM planned",
)
def queue_next_action(spark, sf_dir):
    return mq.next_actions(_reconciled(spark, sf_dir), NOON).select("id", "status", "task_status", "next_action")


@query(
    "queue_run_choice",
    f"""WITH {b.EVENTS_SQL}, {b.QUEUE_SQL}, {b.NEXT_ACTION_SQL} SELECT id, next_action, task_id FROM planned WHERE next_action NOT IN ('skip', 'complete')
ORDER BY next_action NOT IN ('pause', 'wait'), sequence, coalesce(created_at, ''), id LIMIT 1""",
)
def queue_run_choice(spark, sf_dir):
    return mq.run_choice(mq.next_actions(_reconciled(spark, sf_dir), NOON))


@query(
    "queue_source",
    f"WITH {b.QUEUE_SQL.replace('FROM ev ', 'FROM (SELECT NULL AS logical_name, 0 AS event_id, NULL AS metadata, NULL AS task_id) ')}"
    " SELECT id, logical_collection, printf('%02d:%02d', w_start // 60, w_start % 60) AS start, CASE WHEN status = '' THEN 'queued' ELSE status END AS status, task_id, sequence FROM items",
)
def queue_source(spark, sf_dir):
    """Write the queue as stored records and read it back."""
    path = scratch_path(spark, "records")
    items = b.queue_items(spark, sf_dir).withColumn("status", F.when(F.col("status") != "", F.col("status")))
    meta = F.struct("logical_collection", "task_config", "window", "status", "task_id", "last_error", F.col("sequence").cast("int").alias("sequence"))
    items.select("id", "created_at", meta.alias("meta")).write.json(path)
    found = mq.in_order(mq.read_records(spark, path))
    return found.select("id", "logical_collection", F.col("window.start").alias("start"), "status", "task_id", F.col("sequence").cast("bigint").alias("sequence"))
