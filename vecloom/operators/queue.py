"""Migration queue: what each slice's status is, and what should happen to it next.

``items``: ``id, logical_collection, task_config, shards, window struct<start, stop_dispatch, pause_at>, status,
task_id, last_error, created_at, sequence``; ``tasks``: ``task_id, status``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.ordering import newest

ITEM_FIELDS = ", ".join(
    [
        "id: string", "logical_collection: string", "task_config: string", "shards: array<string>",
        "window: struct<start: string, stop_dispatch: string, pause_at: string>", "status: string", "task_id: string",
        "attempts: int", "last_error: string", "created_at: string", "updated_at: string", "note: string",
        "sequence: int", "metadata: string",
    ]
)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue files ``{"items": [...]}``, with an explicit schema."""
    files = spark.read.schema(f"items array<struct<{ITEM_FIELDS}>>").option("multiLine", True).json(path)
    items = files.select(F.explode("items").alias("i")).select("i.*")
    defaults = {"status": "queued", "attempts": 0, "sequence": 0}
    return items.fillna(defaults).withColumn("shards", F.coalesce("shards", F.array().cast("array<string>")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored records ``{"id", "created_at", "updated_at", "meta": {...}}``, one per line.

    The record's id replaces the item's; its times only fill missing ones.
    """
    fields = ITEM_FIELDS
    records = spark.read.schema(f"id string, created_at string, updated_at string, meta struct<{fields}>").json(path)
    lifted = records.select("meta.*", F.col("id").alias("_id"), F.col("created_at").alias("_c"), F.col("updated_at").alias("_u"))
    return (
        lifted.withColumn("id", F.col("_id"))
        .withColumn("created_at", F.coalesce("created_at", "_c"))
        .withColumn("updated_at", F.coalesce("updated_at", "_u"))
        .drop("_id", "_c", "_u")
        .fillna({"status": "queued", "attempts": 0, "sequence": 0})
    )


def queue_order() -> list[Column]:
    return [F.col("sequence"), F.coalesce("created_at", F.lit("")), F.col("id")]


def in_order(items: DataFrame) -> DataFrame:
    return items.orderBy(*queue_order())


def _given(column: Column) -> Column:
    return F.when(column != "", column)


# --- reconciliation -------------------------------------------------------------------------------------


def recover_task_ids(items: DataFrame, events: DataFrame, recent: int | None = None) -> DataFrame:
    """Items without a task take it from the newest event that names them, however old; ``recent`` looks at so many of a collection only."""
    seen = events if recent is None else newest(events, ["logical_name"], F.col("event_id").desc(), recent)
    named = (
        seen.select(
            "logical_name", "event_id", F.trim("task_id").alias("_task"),
            F.get_json_object("metadata", "$.queue_item_id").alias("_item"),
        )
        .filter("_task <> '' and _item is not null")
        .groupBy("logical_name", "_item")
        .agg(F.max_by("_task", "event_id").alias("_task"))
    )
    joined = items.join(
        named, (items.logical_collection == named.logical_name) & (items.id == named._item), "left"
    )
    missing = _given(F.col("task_id")).isNull()
    found = missing & F.col("_task").isNotNull()
    return joined.withColumns(
        {
            "task_id": F.when(missing, F.col("_task")).otherwise(F.col("task_id")),
            "status": F.when(found & F.coalesce("status", F.lit("")).isin("", "queued"), "pending").otherwise(F.col("status")),
        }
    ).select(*items.columns)


def sync_status(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Bring items in line with their tasks; adds ``task_status`` (null: no task, ``missing``: not found)."""
    known = tasks.select(
        F.col("task_id").alias("_tid"), F.coalesce(_given(F.col("status")), F.lit("unknown")).alias("_ts"), F.lit(True).alias("_found")
    )
    joined = items.join(known, items.task_id == F.col("_tid"), "left")
    has_task = _given(F.col("task_id")).isNotNull()
    task_status = F.when(has_task, F.coalesce(F.when(F.col("_found"), F.col("_ts")), F.lit("missing")))
    status, task = F.coalesce("status", F.lit("")), F.col("task_status")
    new_status = (
        F.when(task.isNull(), F.col("status"))
        .when(task == "missing", F.when(status == "completed", "completed").otherwise("failed"))
        .when(task.isin("completed", "failed", "running"), task)
        .when(task == "paused", F.when(status.isin("", "running"), "paused").otherwise(F.col("status")))
        .when(task == "pending", F.when(status == "", "queued").otherwise(F.col("status")))
        .otherwise(task)
    )
    error = (
        F.when(task == "missing", F.concat(F.lit("task "), F.col("task_id"), F.lit(" not found")))
        .when(task == "failed", F.concat(F.lit("task "), F.col("task_id"), F.lit(" failed")))
        .when(task.isin("completed", "running"), F.lit(None).cast("string"))
        .otherwise(F.col("last_error"))
    )
    return (
        joined.withColumn("task_status", task_status)
        .withColumns({"status": new_status, "last_error": error})
        .select(*items.columns, "task_status")
    )


def reconcile(items: DataFrame, events: DataFrame, tasks: DataFrame) -> DataFrame:
    return sync_status(recover_task_ids(items, events), tasks)


# --- planning -------------------------------------------------------------------------------------------


def minutes(clock: Column) -> Column:
    """``"HH:MM"`` as minutes since midnight."""
    parts = F.split(clock, ":")
    return F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("int")


def _now(now: str | Column) -> Column:
    return minutes(F.lit(now)) if isinstance(now, str) else now


def within_window(now: str | Column, wrap: bool = False) -> Column:
    """``start <= now < stop_dispatch`` on one day; ``wrap`` also allows windows across midnight."""
    at, start, stop = _now(now), minutes(F.col("window.start")), minutes(F.col("window.stop_dispatch"))
    same_day = (start <= at) & (at < stop)
    return same_day if not wrap else F.when(start <= stop, same_day).otherwise((at >= start) | (at < stop))


def past_pause(now: str | Column) -> Column:
    return _now(now) >= minutes(F.col("window.pause_at"))


def due(items: DataFrame, now: str | Column) -> DataFrame:
    return items.filter((F.coalesce("status", F.lit("")) != "completed") & within_window(now))


def to_pause(items: DataFrame, now: str | Column) -> DataFrame:
    return items.filter((F.col("status") == "running") & (F.col("task_status") == "running") & past_pause(now))


def next_actions(items: DataFrame, now: str | Column) -> DataFrame:
    """Add ``next_action`` to reconciled items: what a run that reaches this item does with it.

    ``pause, wait`` for running items; for others that are due: ``start`` (a new or a pending task),
    ``resume``, ``complete``, ``fail``, ``none``.  ``skip``: completed or not due.
    """
    task = F.col("task_status")
    config = F.coalesce(F.col("task_config").isNotNull() & ~F.col("task_config").isin("", "{}"), F.lit(False))
    action = (
        F.when(F.col("status") == "running", F.when((task == "running") & past_pause(now), "pause").otherwise("wait"))
        .when((F.col("status") == "completed") | ~within_window(now), "skip")
        .when(task.isNull(), F.when(config, "start").otherwise("fail"))
        .when(task == "paused", "resume")
        .when(task == "pending", "start")
        .when(task == "completed", "complete")
        .when(task.isin("failed", "missing"), "fail")
        .otherwise("none")
    )
    return items.withColumn("next_action", action)


def run_choice(planned: DataFrame) -> DataFrame:
    """The one item a run acts on: the first running one, else the first due one that is not complete.

    A due item that failed ends the run too, so items behind it wait.
    """
    group = F.when(F.col("next_action").isin("pause", "wait"), 0).when(
        F.col("next_action").isin("start", "resume", "fail", "none"), 1
    )
    ranked = planned.withColumn("_order", F.when(group.isNotNull(), F.struct(group, *queue_order())))
    return ranked.agg(F.min_by(F.struct("id", "next_action", "task_id"), "_order").alias("r")).select("r.*").filter("id is not null")
