"""Analysis of request logs: routing, priorities, batches, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.ordering import number_rows
from vecloom.spec import AGING_STEP_MS, OPERATION_PRIORITY, QueueSpec, RoutingRule

REGEX_SPECIAL = set("\\.^$|?*+()[]{}")


def glob_regex(pattern: str) -> str:
    """Shell pattern (``*``, ``?``, ``[abc]``, ``[!abc]``) to an anchored Java regular expression."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if char == "[" else -1
        if char == "[" and close > 0:
            body = pattern[i + 1 : close]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            escaped = "".join("\\" + c if c in "\\[]^&" else c for c in body)
            out.append(f"[{'^' if negated else ''}{escaped}]")
            i = close
        elif char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        else:
            out.append("\\" + char if char in REGEX_SPECIAL else char)
        i += 1
    return "^(?s:" + "".join(out) + ")\\z"


def matches(caller: Column, pattern: str) -> Column:
    """A pattern without wildcards, or with only a trailing ``*``, needs no regular expression."""
    if pattern == "*":
        return caller.isNotNull()
    head, wild = pattern[:-1], set("*?[")
    if not wild & set(pattern):
        return caller == pattern
    if pattern.endswith("*") and not wild & set(head):
        return caller.startswith(head)
    return caller.rlike(glob_regex(pattern))


def route(
    requests: DataFrame, rules: Sequence[RoutingRule], priorities: Mapping[str, int] = OPERATION_PRIORITY
) -> DataFrame:
    """Add ``queue, service_priority, operation, operation_priority, reason`` by the first matching rule.

    A given, non-empty ``operation`` beats the rule's; an unknown operation comes after all known ones.
    """
    def first(value) -> Column:
        chain = None
        for rule in rules:
            test, result = matches(F.col("caller"), rule.caller_pattern), F.lit(value(rule))
            chain = F.when(test, result) if chain is None else chain.when(test, result)
        return chain if chain is not None else F.lit(None)

    asked = F.col("operation") if "operation" in requests.columns else F.lit(None).cast("string")
    routed = requests.withColumns(
        {
            "queue": first(lambda r: r.queue).cast("string"),
            "service_priority": first(lambda r: r.service_priority).cast("bigint"),
            "operation": F.coalesce(F.when(asked != "", asked), first(lambda r: r.operation).cast("string")),
        }
    )
    table = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv]) if priorities else None
    known = F.try_element_at(table, F.col("operation")) if table is not None else F.lit(None)
    unknown = F.lit(max(priorities.values(), default=0) + 1)
    matched = F.col("queue").isNotNull()
    return routed.withColumns(
        {
            "operation_priority": F.when(matched, F.coalesce(known, unknown)).cast("bigint"),
            "operation": F.when(matched, F.col("operation")),
            "reason": F.when(~matched, F.concat(F.lit("No routing rule matched caller: "), F.col("caller"))),
        }
    )


def effective_priority(enqueued_at: Column, now: Column, service_priority: Column, step_ms: int = AGING_STEP_MS) -> Column:
    """Service priority less one for every full ageing step waited, not below zero."""
    waited = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(enqueued_at)) / 1000))
    return F.greatest(F.lit(0), service_priority - F.floor(waited / step_ms)).cast("bigint")


def serving_order(requests: DataFrame, now: Column, step_ms: int = AGING_STEP_MS, tie: str = "request_id") -> DataFrame:
    """Add ``effective_priority`` and ``position``: the order in which waiting requests are best served."""
    aged = requests.withColumn(
        "effective_priority", effective_priority(F.col("enqueued_at"), now, F.col("service_priority"), step_ms)
    )
    order = ["effective_priority", "operation_priority", "enqueued_at", tie]
    return number_rows(aged, [], order, "position")


# --- batches --------------------------------------------------------------------------------------------


def split_parts(texts: DataFrame, max_batch: int | Column, request: str = "request_id", order: str = "ordinal") -> DataFrame:
    """Add ``position`` (from 0 in the request), ``part`` and the part's ``offset``.

    ``texts`` has one row per text.  Parts hold at most ``max_batch`` texts of one request.
    """
    size = F.lit(max_batch) if isinstance(max_batch, int) else max_batch
    numbered = number_rows(texts, [request], [order], "_n").withColumn("position", F.col("_n") - 1).drop("_n")
    part = F.floor(F.col("position") / size).cast("bigint")
    return numbered.withColumn("part", part).withColumn("offset", (F.col("part") * size).cast("bigint"))


def explode_texts(requests: DataFrame, texts: str = "texts") -> DataFrame:
    """Requests with an array of texts to one row per text."""
    others = [c for c in requests.columns if c != texts]
    return requests.select(*others, F.posexplode(texts).alias("ordinal", "text"))


def reassemble(parts: DataFrame, request: str = "request_id") -> DataFrame:
    """Results of parts (``offset`` and ``index`` within the part) back to request order, one row per text."""
    return parts.withColumn("position", F.col("offset") + F.col("index")).drop("offset", "index", "part")


def bounded_batches(
    texts: DataFrame, key: Sequence[str], arrival: Sequence, max_batch: int | Column, name: str = "batch_no"
) -> DataFrame:
    """Number the batches of each ``key``: consecutive texts in arrival order, at most ``max_batch`` each."""
    size = F.lit(max_batch) if isinstance(max_batch, int) else max_batch
    numbered = number_rows(texts, key, arrival, "_n")
    return numbered.withColumn(name, F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


# --- metrics --------------------------------------------------------------------------------------------


def endpoint_metrics(log: DataFrame, *by) -> DataFrame:
    """Requests, failures, mean latency and mean queue wait per endpoint.

    ``log``: ``endpoint, latency_ms, queue_wait_ms, failed``.
    """
    return log.groupBy(*by, "endpoint").agg(*metric_columns())


def mean2(total: Column, n: Column) -> Column:
    """``total / n`` to two decimals, halves up, in whole numbers: the same whatever the order of the sum."""
    return F.call_function("div", total * 200 + n, n * 2) / F.lit(100.0)


def metric_columns() -> list[Column]:
    n = F.count("*")
    waits = F.coalesce(F.col("queue_wait_ms").cast("bigint"), F.lit(0))
    return [
        n.alias("requests"),
        F.count(F.when(F.col("failed"), 1)).alias("failures"),
        mean2(F.sum(F.col("latency_ms").cast("bigint")), n).alias("avg_latency_ms"),
        mean2(F.sum(waits), n).alias("avg_queue_wait_ms"),
    ]


def batch_metrics(batched: DataFrame, key: Sequence[str], queue: str = "queue", batch: str = "batch_no") -> DataFrame:
    """Batches and items per queue.  A queue's rows are summed per batch first, so it never is one group of rows."""
    sizes = batched.groupBy(*dict.fromkeys([queue, *key]), batch).agg(F.count("*").alias("_n"))
    return sizes.groupBy(queue).agg(F.count("*").alias("batches"), F.sum("_n").alias("items"))


def queue_depth(spark: SparkSession, pending: DataFrame, queues: Sequence[QueueSpec]) -> DataFrame:
    """Pending requests and texts per configured queue, zero where nothing waits.

    ``pending``: one row per pending request, ``queue, n_texts``.
    """
    configured = spark.createDataFrame(
        [(q.name, q.max_batch_size, q.max_wait_ms) for q in queues], "queue string, max_batch_size bigint, max_wait_ms bigint"
    )
    counts = pending.groupBy("queue").agg(F.count("*").alias("requests"), F.sum("n_texts").alias("texts"))
    return configured.join(counts, "queue", "left").select(
        "queue", F.coalesce("requests", F.lit(0)).alias("pending_requests"),
        F.coalesce("texts", F.lit(0)).cast("bigint").alias("pending_texts"), "max_batch_size", "max_wait_ms",
    )


def failure_status(status: Column, error_class: Column, message: Column) -> Column:
    """HTTP status of a store failure: 404 not found, 504 timed out, else 502."""
    name, text = F.coalesce(F.lower(error_class), F.lit("")), F.coalesce(F.lower(message), F.lit(""))
    return (
        F.when(F.coalesce(status, F.lit(0)) == 404, 404)
        .when(text.contains("404") & text.contains("not found"), 404)
        .when(name.contains("timeout") | text.contains("timeout") | text.contains("timed out"), 504)
        .otherwise(502)
        .cast("bigint")
    )
