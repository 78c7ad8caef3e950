"""How the stored tables stand for collections, requests and logs.

* point: an embedding and the document of the same number, either may be missing; payload from both and
  from ``labels``;
* search request: a benchmark item, its text and the embedding of the same number;
* request log, migration events: ``events``;  queue items and tasks: ``orders``.

Each Spark binding has the SQL that builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.text import sparse_terms
from vecloom.sources.tables import spread


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; its schema is looked up once, as reading it from the files is a job of its own."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def text_id(column: str) -> Column:
    return F.col(column).cast("string")


# --- points and requests --------------------------------------------------------------------------------


def embedded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        text_id("vec_id").alias("id"), F.col("embedding").alias("dense"), "label"
    )


def texts(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(text_id("doc_id").alias("id"), "text", "lang", "source", "n_chars")


def sparse_texts(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir).select("id", sparse_terms(F.col("text")).alias("sparse"), "lang", "source")


def points(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        text_id("doc_id").alias("id"), "quality", (F.col("toxic") == 1).alias("toxic")
    )
    return embedded(spark, sf_dir).join(texts(spark, sf_dir), "id", "full_outer").join(labels, "id", "left")


POINTS_SQL = """
points AS (
  SELECT CAST(coalesce(e.vec_id, d.doc_id) AS VARCHAR) AS id, e.embedding AS dense, e.label,
         d.text, d.lang, d.source, d.n_chars, l.quality, (l.toxic = 1) AS toxic
  FROM embeddings e FULL OUTER JOIN documents d ON e.vec_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = coalesce(e.vec_id, d.doc_id)
)"""


def requests(spark, sf_dir) -> DataFrame:
    """``query_id, text, vector``; the vector is null where no embedding has the item's number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(vectors, "query_id", "left")


def sparse_requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), sparse_terms(F.col("text")).alias("sparse")
    )


QUERIES_SQL = """
q AS (
  SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS v
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id
)"""


def terms_sql(name: str, key: str, source: str) -> str:
    """CTE ``name (key, index, value)``: sparse terms of ``source (key, text)``."""
    return f"""
{name} AS (
  SELECT {key}, index, round(tf / n * (1 + ln(1 + tf)), 6) AS value
  FROM (
    SELECT {key}, index, count(*)::DOUBLE AS tf, any_value(n)::DOUBLE AS n
    FROM (
      SELECT {key}, len(toks) AS n, ('0x' || substr(md5(lower(unnest(toks))), 1, 8))::BIGINT % 2147483647 AS index
      FROM (SELECT {key}, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS toks FROM {source})
    )
    GROUP BY {key}, index
  )
)"""


DOC_TERMS_SQL = terms_sql("p", "id", "(SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)")
QUERY_TERMS_SQL = terms_sql("t", "query_id", "(SELECT item_id AS query_id, text FROM benchmark)")


def top_sql(scores: str, k: int, direction: str = "DESC", extra: str = "") -> str:
    """Rank a relation ``(query_id, id, score)`` and keep ``k`` per query."""
    return f"""
SELECT query_id, rank, id, score{extra} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, id) AS rank FROM {scores}
) WHERE rank <= {k}"""


# --- request log ----------------------------------------------------------------------------------------


def json_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def request_log(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    family = F.when(kind == "view", "realtime").when(kind == "click", "interactive").when(kind == "signup", "batch").when(
        kind == "error", "probe"
    ).otherwise("job")
    log = table(spark, sf_dir, "events").withColumn("k", json_k())
    return log.select(
        F.col("event_id").alias("request_id"),
        F.concat(family, F.lit("/"), F.col("user_id").cast("string")).alias("caller"),
        F.when(kind == "click", "count").when(kind == "signup", "").when(F.col("value") > 50, "reindex").alias("operation"),
        kind.alias("endpoint"),
        F.col("ts"),
        F.col("ts").cast("timestamp").alias("enqueued_at"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.col("k").alias("queue_wait_ms"),
        ((kind == "error") | (F.col("value") > 100)).alias("failed"),
        F.col("k").alias("n_texts"),
        F.col("user_id"), F.col("value"),
    )


REQUEST_LOG_SQL = """
log AS (
  SELECT event_id AS request_id,
    CASE event_type WHEN 'view' THEN 'realtime' WHEN 'click' THEN 'interactive' WHEN 'signup' THEN 'batch'
      WHEN 'error' THEN 'probe' ELSE 'job' END || '/' || user_id AS caller,
    CASE WHEN event_type = 'click' THEN 'count' WHEN event_type = 'signup' THEN '' WHEN value > 50 THEN 'reindex' END AS operation,
    event_type AS endpoint, ts, ts AS enqueued_at,
    CAST(floor(value * 10) AS BIGINT) AS latency_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS queue_wait_ms,
    (event_type = 'error' OR value > 100) AS failed,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS n_texts,
    user_id, value
  FROM events
)"""


# --- migration events -----------------------------------------------------------------------------------


def migration_events(spark, sf_dir) -> DataFrame:
    """Every user is a logical collection, every event a phase change; a bootstrap comes before the first."""
    kind = F.col("event_type")
    action = (
        F.when(kind == "view", F.when(F.col("value") > 20, "verify").otherwise("prepare"))
        .when(kind == "click", "dual_write")
        .when(kind == "signup", "backfill")
        .when(kind == "purchase", "cutover")
        .otherwise(F.when(F.col("value") > 20, "bootstrap_sync").otherwise("rollback"))
    )
    src = spread(table(spark, sf_dir, "events"))
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    # In a step of its own, so that the JSON is read once per row and not once per use.
    k, event = F.col("k"), F.col("event")
    log = src.withColumns({"k": json_k(), "event": action})
    state = (
        F.when(event == "cutover", "live").when(event == "bootstrap_sync", "idle").otherwise(event)
    )
    synced = F.concat(F.lit("sync_"), k.cast("string"))
    none = F.lit(None).cast("string")
    version = F.concat(F.lit("v"), (2 + k % 3).cast("string"))
    phases = log.select(
        F.col("event_id"), name.alias("logical_name"), event.alias("event"), state.alias("state"),
        F.when(event == "bootstrap_sync", synced).alias("read_target"),
        F.when(event == "bootstrap_sync", F.array(synced, F.lit("v2"))).alias("write_targets"),
        F.when(event.isin("prepare", "dual_write", "cutover"), version).alias("next_target"),
        none.alias("rollback_target"),
        F.when(event.isin("prepare", "dual_write", "backfill") & (k > 30), F.concat(F.lit("task-e"), F.col("event_id").cast("string"))).alias("task_id"),
        F.when(k > 50, F.concat(F.lit("note "), k.cast("string"))).alias("note"),
        F.when((event == "verify") & (k > 40), "ok").alias("result"),
        F.concat(
            F.lit('{"queue_item_id": "item-'), (F.col("user_id") + 150 * k).cast("string"),
            F.lit('", "checkpoint": {"last_id": "'), k.cast("string"), F.lit('"}}'),
        ).alias("metadata"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    first = F.concat(F.lit("v1_"), F.col("user_id").cast("string"))
    boots = src.select("user_id").distinct().select(
        (F.col("user_id") - 1_000_000_000).alias("event_id"), name.alias("logical_name"),
        F.lit("bootstrap").alias("event"), F.lit("idle").alias("state"), first.alias("read_target"),
        F.array(first).alias("write_targets"), none.alias("next_target"), first.alias("rollback_target"),
        none.alias("task_id"), none.alias("note"), none.alias("result"), F.lit("{}").alias("metadata"),
        F.lit("2023-12-31 00:00:00").alias("created_at"),
    )
    return boots.unionByName(phases)


EVENTS_SQL = """
raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'view' THEN CASE WHEN value > 20 THEN 'verify' ELSE 'prepare' END
      WHEN 'click' THEN 'dual_write' WHEN 'signup' THEN 'backfill' WHEN 'purchase' THEN 'cutover'
      ELSE CASE WHEN value > 20 THEN 'bootstrap_sync' ELSE 'rollback' END END AS event
  FROM events
),
ev AS (
  SELECT user_id - 1000000000 AS event_id, 'u' || user_id AS logical_name, 'bootstrap' AS event, 'idle' AS state,
    'v1_' || user_id AS read_target, ['v1_' || user_id] AS write_targets, NULL AS next_target,
    'v1_' || user_id AS rollback_target, NULL AS task_id, NULL AS note, NULL AS result, '{}' AS metadata,
    '2023-12-31 00:00:00' AS created_at
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT event_id, 'u' || user_id, event,
    CASE event WHEN 'cutover' THEN 'live' WHEN 'bootstrap_sync' THEN 'idle' ELSE event END,
    CASE WHEN event = 'bootstrap_sync' THEN 'sync_' || k END,
    CASE WHEN event = 'bootstrap_sync' THEN ['sync_' || k, 'v2'] END,
    CASE WHEN event IN ('prepare', 'dual_write', 'cutover') THEN 'v' || (2 + k % 3) END,
    NULL,
    CASE WHEN event IN ('prepare', 'dual_write', 'backfill') AND k > 30 THEN 'task-e' || event_id END,
    CASE WHEN k > 50 THEN 'note ' || k END,
    CASE WHEN event = 'verify' AND k > 40 THEN 'ok' END,
    '{"queue_item_id": "item-' || (user_id + 150 * k) || '", "checkpoint": {"last_id": "' || k || '"}}',
    strftime(ts, '%Y-%m-%d %H:%M:%S')
  FROM raw
)"""

# Current state per logical collection, as CTE ``states`` (needs ``ev``).
STATES_SQL = """
rb AS (
  SELECT logical_name, coalesce(rollback_target, read_target) AS rollback_target FROM ev
  WHERE event IN ('bootstrap', 'bootstrap_sync') AND coalesce(rollback_target, read_target) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id) = 1
),
bs AS (
  SELECT ev.logical_name, event_id AS base_id, rb.rollback_target,
    CASE event WHEN 'cutover' THEN next_target WHEN 'rollback' THEN rb.rollback_target ELSE ev.read_target END AS read_target,
    CASE event WHEN 'cutover' THEN [next_target] WHEN 'rollback' THEN [rb.rollback_target] ELSE write_targets END AS writes
  FROM ev JOIN rb USING (logical_name)
  WHERE event IN ('bootstrap', 'bootstrap_sync', 'cutover', 'rollback')
  QUALIFY row_number() OVER (PARTITION BY ev.logical_name ORDER BY event_id DESC) = 1
),
dw AS (
  SELECT logical_name, string_agg(next_target, ',' ORDER BY first) AS added FROM (
    SELECT ev.logical_name, ev.next_target, min(ev.event_id) AS first
    FROM ev JOIN bs USING (logical_name)
    WHERE event = 'dual_write' AND ev.event_id > base_id AND NOT list_contains(writes, ev.next_target)
    GROUP BY ev.logical_name, ev.next_target
  ) GROUP BY logical_name
),
lt AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id DESC) = 1),
vf AS (SELECT * FROM ev WHERE event = 'verify' QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id DESC) = 1),
co AS (SELECT * FROM ev WHERE event = 'cutover' QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id DESC) = 1),
tk AS (SELECT * FROM ev WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY logical_name ORDER BY event_id DESC) = 1),
states AS (
  SELECT bs.logical_name, lt.state, bs.read_target,
    concat_ws(',', array_to_string(writes, ','), added) AS write_targets, bs.rollback_target, tk.task_id,
    vf.created_at AS last_verify_at, CASE WHEN vf.event_id IS NOT NULL THEN coalesce(vf.result, 'pending') END AS last_verify_result,
    co.created_at AS last_cutover_at, lt.note, lt.created_at AS updated_at
  FROM bs JOIN lt USING (logical_name) LEFT JOIN dw USING (logical_name) LEFT JOIN vf USING (logical_name)
  LEFT JOIN co USING (logical_name) LEFT JOIN tk USING (logical_name)
)"""


# --- migration queue ------------------------------------------------------------------------------------


def queue_items(spark, sf_dir) -> DataFrame:
    start = F.col("o_custkey") % 1440

    def clock(m: Column) -> Column:
        m = F.least(m, F.lit(1439)).cast("int")
        return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))

    open_ = F.col("o_orderstatus") == "O"
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("item-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("u"), (F.col("o_orderkey") % 150).cast("string")).alias("logical_collection"),
        F.when(~urgent, '{"source": {}}').alias("task_config"),
        F.struct(
            clock(start).alias("start"), clock(start + 35).alias("stop_dispatch"), clock(start + 40).alias("pause_at")
        ).alias("window"),
        F.when(open_, "queued").when(F.col("o_orderstatus") == "P", "running").when(urgent, "completed").otherwise("").alias("status"),
        F.when(~open_, F.concat(F.lit("task-o"), F.col("o_orderkey").cast("string"))).alias("task_id"),
        F.when(~open_, F.lit("old error")).alias("last_error"),
        F.when(~open_, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created_at"),
        F.col("o_custkey").alias("sequence"),
    )


def tasks(spark, sf_dir) -> DataFrame:
    p = F.col("o_orderpriority")
    of_orders = table(spark, sf_dir, "orders").filter(p != "4-NOT SPECIFIED").select(
        F.concat(F.lit("task-o"), F.col("o_orderkey").cast("string")).alias("task_id"),
        F.when(p == "1-URGENT", "completed").when(p == "2-HIGH", "running").when(p == "3-MEDIUM", "paused").otherwise("pending").alias("status"),
    )
    kind = F.col("event_type")
    of_events = table(spark, sf_dir, "events").filter("value < 30").select(
        F.concat(F.lit("task-e"), F.col("event_id").cast("string")).alias("task_id"),
        F.when(kind == "view", "pending").when(kind == "click", "failed").otherwise("verifying").alias("status"),
    )
    return of_orders.unionByName(of_events)


QUEUE_SQL = """
items AS (
  SELECT 'item-' || o_orderkey AS id, 'u' || (o_orderkey % 150) AS logical_collection,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN '{"source": {}}' END AS task_config,
    o_custkey % 1440 AS w_start, least(o_custkey % 1440 + 35, 1439) AS w_stop, least(o_custkey % 1440 + 40, 1439) AS w_pause,
    CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running'
      WHEN o_orderpriority = '1-URGENT' THEN 'completed' ELSE '' END AS status,
    CASE WHEN o_orderstatus <> 'O' THEN 'task-o' || o_orderkey END AS task_id,
    CASE WHEN o_orderstatus <> 'O' THEN 'old error' END AS last_error,
    CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_at,
    o_custkey AS sequence
  FROM orders
),
tasks AS (
  SELECT 'task-o' || o_orderkey AS task_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'running'
    WHEN '3-MEDIUM' THEN 'paused' ELSE 'pending' END AS status
  FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
  UNION ALL
  SELECT 'task-e' || event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'failed' ELSE 'verifying' END
  FROM events WHERE value < 30
),
recovered AS (
  SELECT logical_name, json_extract_string(metadata, '$.queue_item_id') AS item, trim(task_id) AS task_id FROM ev
  WHERE trim(task_id) <> '' AND json_extract_string(metadata, '$.queue_item_id') IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY logical_name, item ORDER BY event_id DESC) = 1
),
with_task AS (
  SELECT items.* EXCLUDE (task_id, status), coalesce(items.task_id, r.task_id) AS task_id,
    CASE WHEN items.task_id IS NULL AND r.task_id IS NOT NULL AND status IN ('', 'queued') THEN 'pending' ELSE status END AS status
  FROM items LEFT JOIN recovered r ON r.logical_name = logical_collection AND r.item = id
),
joined AS (
  SELECT w.*, CASE WHEN w.task_id IS NOT NULL THEN coalesce(t.status, 'missing') END AS task_status
  FROM with_task w LEFT JOIN tasks t ON t.task_id = w.task_id
),
synced AS (
  SELECT * EXCLUDE (status, last_error),
    CASE WHEN task_status IS NULL THEN status
      WHEN task_status = 'missing' THEN CASE WHEN status = 'completed' THEN 'completed' ELSE 'failed' END
      WHEN task_status IN ('completed', 'failed', 'running') THEN task_status
      WHEN task_status = 'paused' THEN CASE WHEN status IN ('', 'running') THEN 'paused' ELSE status END
      WHEN task_status = 'pending' THEN CASE WHEN status = '' THEN 'queued' ELSE status END
      ELSE task_status END AS status,
    CASE WHEN task_status = 'missing' THEN 'task ' || task_id || ' not found'
      WHEN task_status = 'failed' THEN 'task ' || task_id || ' failed'
      WHEN task_status IN ('completed', 'running') THEN NULL ELSE last_error END AS last_error
  FROM joined
)"""

NEXT_ACTION_SQL = """
planned AS (
  SELECT *, CASE
    WHEN status = 'running' THEN CASE WHEN task_status = 'running' AND 720 >= w_pause THEN 'pause' ELSE 'wait' END
    WHEN status = 'completed' OR NOT (w_start <= 720 AND 720 < w_stop) THEN 'skip'
    WHEN task_status IS NULL THEN CASE WHEN task_config IS NOT NULL THEN 'start' ELSE 'fail' END
    WHEN task_status = 'paused' THEN 'resume' WHEN task_status = 'pending' THEN 'start'
    WHEN task_status = 'completed' THEN 'complete' WHEN task_status IN ('failed', 'missing') THEN 'fail'
    ELSE 'none' END AS next_action
  FROM synced
)"""
