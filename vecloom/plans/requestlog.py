"""Queries over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.operators import requestlog as r
from vecloom.operators.packing import packed_batches
from vecloom.plans import bindings as b
from vecloom.plans.registry import query
from vecloom.spec import QueueSpec, RoutingRule

RULES = (
    RoutingRule("interactive/1", "interactive", 0, "search"),
    RoutingRule("interactive/[2-4]?", "interactive", 2, "search"),
    RoutingRule("realtime/*", "realtime", 0, "query"),
    RoutingRule("interactive/*", "interactive", 1, "search"),
    RoutingRule("batch/*", "batch", 3, "upsert"),
    RoutingRule("job/?", "batch", 3, "backfill"),
    RoutingRule("job/[!1-5]*", "batch", 2, "upsert"),
)
QUEUES = (QueueSpec("realtime", 8, 15), QueueSpec("interactive", 32, 50), QueueSpec("batch", 128, 200), QueueSpec("idle", 8, 15))

ROUTED_SQL = f"""{b.REQUEST_LOG_SQL},
hit AS (SELECT *, CASE WHEN caller = 'interactive/1' THEN 1 WHEN caller GLOB 'interactive/[2-4]?' THEN 2 WHEN caller GLOB 'realtime/*' THEN 3 WHEN caller GLOB 'interactive/*' THEN 4
  WHEN caller GLOB 'batch/*' THEN 5 WHEN caller GLOB 'job/?' THEN 6 WHEN caller GLOB 'job/[!1-5]*' THEN 7 END AS rule FROM log),
rt AS (SELECT * EXCLUDE (operation, rule),
  CASE WHEN rule IN (1, 2, 4) THEN 'interactive' WHEN rule = 3 THEN 'realtime' WHEN rule IN (5, 6, 7) THEN 'batch' END AS queue,
  CASE rule WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN 3 WHEN 7 THEN 2 END::BIGINT AS service_priority,
  CASE WHEN rule IS NOT NULL THEN coalesce(nullif(operation, ''), CASE rule WHEN 3 THEN 'query' WHEN 5 THEN 'upsert' WHEN 6 THEN 'backfill' WHEN 7 THEN 'upsert' ELSE 'search' END) END AS operation,
  CASE WHEN rule IS NULL THEN 'No routing rule matched caller: ' || caller END AS reason FROM hit),
routed AS (SELECT *, CASE WHEN queue IS NOT NULL THEN CASE operation WHEN 'query' THEN 0 WHEN 'search' THEN 1 WHEN 'retrieve' THEN 1 WHEN 'count' THEN 1 WHEN 'scroll' THEN 1
  WHEN 'upsert' THEN 2 WHEN 'backfill' THEN 3 ELSE 4 END END::BIGINT AS operation_priority FROM rt)"""


def routed(spark, sf_dir):
    return r.route(b.request_log(spark, sf_dir), RULES)


@query(
    "route_requests",
    f"WITH {ROUTED_SQL} SELECT request_id, caller, queue, service_priority, operation, operation_priority, reason FROM routed",
)
def route_requests(spark, sf_dir):
    return routed(spark, sf_dir).select("request_id", "caller", "queue", "service_priority", "operation", "operation_priority", "reason")


NOW = "2024-01-30 23:59:59"


@query(
    "serving_order",
    f"""WITH {ROUTED_SQL}, p AS (SELECT request_id, greatest(0, service_priority - floor(greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(enqueued_at)) / 1000)) / 600000000))::BIGINT AS effective_priority,
  operation_priority, enqueued_at FROM routed WHERE queue IS NOT NULL)
SELECT request_id, effective_priority, row_number() OVER (ORDER BY effective_priority, operation_priority, enqueued_at, request_id) AS position FROM p""",
)
def serving_order(spark, sf_dir):
    """The whole log in serving order, with an ageing step long enough for the data to matter."""
    waiting = routed(spark, sf_dir).filter("queue is not null").select(
        "request_id", "service_priority", "operation_priority", "enqueued_at"
    )
    placed = r.serving_order(waiting, F.lit(NOW).cast("timestamp"), 600_000_000)
    return placed.select("request_id", "effective_priority", "position")


METRICS_SQL = """count(*) AS requests, count(*) FILTER (WHERE failed) AS failures,
  ((sum(latency_ms)::BIGINT * 200 + count(*)) // (2 * count(*))) / 100.0 AS avg_latency_ms,
  ((sum(queue_wait_ms)::BIGINT * 200 + count(*)) // (2 * count(*))) / 100.0 AS avg_queue_wait_ms"""


def as_double(sql: str) -> str:
    return sql.replace("/ 100.0", "/ 100.0::DOUBLE")


@query("endpoint_metrics", f"WITH {b.REQUEST_LOG_SQL} SELECT endpoint, {as_double(METRICS_SQL)} FROM log GROUP BY endpoint")
def endpoint_metrics(spark, sf_dir):
    return r.endpoint_metrics(b.request_log(spark, sf_dir))


@query(
    "queue_depth",
    f"""WITH {ROUTED_SQL}, q AS (SELECT * FROM (VALUES ('realtime', 8, 15), ('interactive', 32, 50), ('batch', 128, 200), ('idle', 8, 15)) AS t(queue, a, b))
SELECT q.queue, count(request_id) AS pending_requests, coalesce(sum(n_texts), 0)::BIGINT AS pending_texts, a::BIGINT AS max_batch_size, b::BIGINT AS max_wait_ms
FROM q LEFT JOIN routed ON routed.queue = q.queue GROUP BY ALL""",
)
def queue_depth(spark, sf_dir):
    return r.queue_depth(spark, routed(spark, sf_dir), QUEUES)


BATCH_KEY = ["queue", "service_priority", "operation_priority"]
BATCHES_SQL = f"""{ROUTED_SQL}, bt AS (SELECT request_id, queue, service_priority, operation_priority,
  (row_number() OVER (PARTITION BY queue, service_priority, operation_priority ORDER BY enqueued_at, request_id) - 1)
  // CASE queue WHEN 'realtime' THEN 8 WHEN 'interactive' THEN 32 ELSE 128 END AS batch_no FROM routed WHERE queue IS NOT NULL)"""


def batched(spark, sf_dir):
    size = F.when(F.col("queue") == "realtime", 8).when(F.col("queue") == "interactive", 32).otherwise(128)
    waiting = routed(spark, sf_dir).filter("queue is not null").select("request_id", *BATCH_KEY, "enqueued_at")
    return r.bounded_batches(waiting, BATCH_KEY, ["enqueued_at", "request_id"], size)


@query("bounded_batches", f"WITH {BATCHES_SQL} SELECT request_id, queue, service_priority, operation_priority, batch_no FROM bt")
def bounded_batches(spark, sf_dir):
    return batched(spark, sf_dir).select("request_id", *BATCH_KEY, "batch_no")


PACK_KEY = [*BATCH_KEY, "model", "device"]
PACKED_SQL = f"""{ROUTED_SQL}, pq AS (
  SELECT request_id, queue, service_priority, operation_priority, 'm' || (user_id % 2) AS model, CASE WHEN value > 40 THEN 'gpu' ELSE 'cpu' END AS device,
    greatest(n_texts, 1) AS n, CASE queue WHEN 'realtime' THEN 8 WHEN 'interactive' THEN 32 ELSE 128 END AS top, enqueued_at FROM routed WHERE queue IS NOT NULL),
line AS (
  SELECT *, dense_rank() OVER (ORDER BY queue, service_priority, operation_priority, model, device) AS k,
    row_number() OVER (PARTITION BY queue, service_priority, operation_priority, model, device ORDER BY enqueued_at, request_id) AS i FROM pq),
walk AS (
  SELECT k, i, n AS total, 0::BIGINT AS batch_no FROM line WHERE i = 1
  UNION ALL
  SELECT l.k, l.i, CASE WHEN w.total >= top OR w.total + n > top THEN n ELSE w.total + n END,
    CASE WHEN w.total >= top OR w.total + n > top THEN batch_no + 1 ELSE batch_no END
  FROM walk w JOIN line l ON l.k = w.k AND l.i = w.i + 1)"""


@query(
    "packed_batches",
    f"WITH RECURSIVE {PACKED_SQL} SELECT request_id, queue, service_priority, operation_priority, model, device, n AS texts, batch_no FROM walk JOIN line USING (k, i)",
)
def packed(spark, sf_dir):
    """Requests of several texts: each joins the open batch of its queue, priorities, model and device if it fits."""
    size = F.when(F.col("queue") == "realtime", 8).when(F.col("queue") == "interactive", 32).otherwise(128)
    waiting = routed(spark, sf_dir).filter("queue is not null").select(
        "request_id", *BATCH_KEY, F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"),
        F.when(F.col("value") > 40, "gpu").otherwise("cpu").alias("device"), F.greatest("n_texts", F.lit(1).cast("bigint")).alias("texts"), "enqueued_at",
    )
    found = packed_batches(waiting, PACK_KEY, ["enqueued_at", "request_id"], "texts", size)
    return found.select("request_id", *PACK_KEY, "texts", "batch_no")


@query(
    "batch_metrics",
    f"WITH {BATCHES_SQL} SELECT queue, count(*) AS batches, sum(n)::BIGINT AS items FROM"
    " (SELECT queue, service_priority, operation_priority, batch_no, count(*) AS n FROM bt GROUP BY ALL) GROUP BY queue",
)
def batch_metrics(spark, sf_dir):
    return r.batch_metrics(batched(spark, sf_dir), BATCH_KEY)


PARTS_SQL = """pt AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, text FROM conversations)"""


@query(
    "split_parts",
    f'WITH {PARTS_SQL} SELECT conv_id, turn, position, position // 3 AS part, position // 3 * 3 AS "offset" FROM pt',
)
def split_parts(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return r.split_parts(turns, 3, "conv_id", "turn")


@query("reassemble_parts", f"WITH {PARTS_SQL} SELECT conv_id, position, length(text) AS n FROM pt")
def reassemble_parts(spark, sf_dir):
    """Split requests into parts, work on each text of a part, put the results back in request order."""
    turns = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    parts = r.split_parts(turns, 3, "conv_id", "turn")
    done = parts.select("conv_id", "part", "offset", (F.col("position") - F.col("offset")).alias("index"), F.length("text").cast("bigint").alias("n"))
    return r.reassemble(done, "conv_id")


@query(
    "failure_classes",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 404 WHEN event_type = 'click' AND value > 10 THEN 404 WHEN event_type = 'click' THEN 502
  WHEN event_type = 'signup' THEN 504 WHEN event_type = 'purchase' AND value > 10 THEN 504 ELSE 502 END::BIGINT AS status FROM events""",
)
def failure_classes(spark, sf_dir):
    kind, big = F.col("event_type"), F.col("value") > 10
    log = b.table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "view", 404).when(kind == "error", 500).alias("code"),
        F.when(kind == "signup", "ReadTimeout").otherwise("StoreError").alias("error_class"),
        F.when(kind == "click", F.when(big, "Unexpected 404: collection Not Found").otherwise("404"))
        .when((kind == "purchase") & big, "request timed out").alias("message"),
    )
    return log.select("event_id", r.failure_status(F.col("code"), F.col("error_class"), F.col("message")).alias("status"))
