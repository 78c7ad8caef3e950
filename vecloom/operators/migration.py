"""Migration event log: current routing, routing over time, phases, verification.

``events`` is an append-only table::

    event_id bigint, logical_name string, event string, state string, read_target string,
    write_targets array<string>, next_target string, rollback_target string, task_id string,
    note string, result string, metadata string (JSON), created_at string

``read_target`` / ``write_targets`` / ``rollback_target`` are recorded by bootstrap and bootstrap_sync,
``next_target`` by prepare, dual_write and cutover, so past routing never depends on present configuration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.ordering import forward_fill, newest
from vecloom.spec import LogicalSpec

EVENT_SCHEMA = (
    "event_id bigint, logical_name string, event string, state string, read_target string,"
    " write_targets array<string>, next_target string, rollback_target string, task_id string,"
    " note string, result string, metadata string, created_at string"
)
# Action -> state it leaves the collection in.
STATE_AFTER = {
    "bootstrap": "idle",
    "bootstrap_sync": "idle",
    "prepare": "prepare",
    "dual_write": "dual_write",
    "backfill": "backfill",
    "verify": "verify",
    "cutover": "live",
    "rollback": "rollback",
}
# Events that set the targets outright.
BASES = ("bootstrap", "bootstrap_sync", "cutover", "rollback")
# Those of them that may name the rollback target.
ORIGINS = ("bootstrap", "bootstrap_sync")
RECENT = 20
RECENT_MAX = 200


def normalise_action(action: Column) -> Column:
    """Actions arrive spelt with a hyphen, events are recorded with an underscore."""
    return F.regexp_replace(action, "-", "_")


def state_after(event: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATE_AFTER.items() for x in kv]), event)


def phase_events(actions: DataFrame, logical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested actions to events: ``(events, rejected)``.

    ``actions``: ``event_id, logical_name, action, task_id, note, result, metadata, created_at``; ``logical``:
    ``logical_name, next_target`` from the configuration.  Any action is accepted in any state.
    """
    known = logical.select("logical_name", F.col("next_target").alias("_next"), F.lit(True).alias("_known"))
    named = actions.withColumn("event", normalise_action(F.col("action"))).join(known, "logical_name", "left")
    needs_next = F.col("event").isin("prepare", "dual_write", "cutover")
    callable_ = F.col("event").isin("prepare", "dual_write", "backfill", "verify", "cutover", "rollback")
    reason = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Unknown logical collection: "), F.col("logical_name")))
        .when(~F.coalesce(callable_, F.lit(False)), F.concat(F.lit("Unsupported migration action: "), F.col("action")))
        .when(
            needs_next & F.coalesce(F.col("_next") == "", F.lit(True)),
            F.concat(F.lit("Logical collection '"), F.col("logical_name"), F.lit("' has no configured next_target")),
        )
    )
    # Which event carries which fields: only prepare, dual-write and backfill may name a task.
    task = F.when(F.col("event").isin("prepare", "dual_write", "backfill"), F.when(F.col("task_id") != "", F.col("task_id")))
    made = named.select(
        "event_id", "logical_name", "event", state_after(F.col("event")).alias("state"),
        F.lit(None).cast("string").alias("read_target"), F.lit(None).cast("array<string>").alias("write_targets"),
        F.when(needs_next, F.col("_next")).alias("next_target"), F.lit(None).cast("string").alias("rollback_target"),
        task.alias("task_id"), "note",
        F.when(F.col("event") == "verify", F.coalesce(F.when(F.col("result") != "", F.col("result")), F.lit("pending"))).alias("result"),
        "metadata", "created_at", reason.alias("reason"),
    )
    return made.filter("reason is null").drop("reason"), made.filter("reason is not null").select(
        "event_id", "logical_name", "event", "reason"
    )


def current_state(events: DataFrame) -> DataFrame:
    """The state of every logical collection: one fold over the log, without replaying it.

    Everything is a ``max_by`` over one key, combined on the map side, so a collection that owns a third of
    the log costs one row per task.
    """
    event, eid = F.col("event"), F.col("event_id")

    def newest_of(value: str | Column, where: Column) -> Column:
        return F.max_by(value, F.when(where, eid))

    origin = event.isin(*ORIGINS)
    base_row = F.struct("event_id", "event", "read_target", "write_targets", "next_target")
    origin_target = F.coalesce("rollback_target", "read_target")
    folded = events.groupBy("logical_name").agg(
        # The note is the one field an event without a value clears.
        F.max_by(F.struct("state", "note", "created_at"), eid).alias("_last"),
        newest_of(base_row, event.isin(*BASES)).alias("_base"),
        F.min_by(origin_target, F.when(origin & origin_target.isNotNull(), eid)).alias("rollback_target"),
        newest_of("task_id", F.col("task_id").isNotNull()).alias("task_id"),
        newest_of(F.struct("created_at", F.coalesce("result", F.lit("pending")).alias("result")), event == "verify").alias("_verify"),
        newest_of("created_at", event == "cutover").alias("last_cutover_at"),
    ).withColumns(
        {
            "state": F.col("_last.state"), "note": F.col("_last.note"), "updated_at": F.col("_last.created_at"),
            "last_verify_at": F.col("_verify.created_at"), "last_verify_result": F.col("_verify.result"),
        }
    )
    targets = _base_targets(F.col("_base"), F.col("rollback_target"))
    bases = folded.select("*", F.col("_base.event_id").alias("_base_id"), *targets)
    added = (
        events.filter(event == "dual_write")
        .select("logical_name", "next_target", "event_id")
        .join(bases.select("logical_name", "_base_id", "_base_writes"), "logical_name")
        .filter((eid > F.coalesce("_base_id", F.lit(-1))) & F.col("next_target").isNotNull())
        .filter(~F.coalesce(F.array_contains("_base_writes", F.col("next_target")), F.lit(False)))
        .groupBy("logical_name", "next_target")
        .agg(F.min("event_id").alias("first"))
        # One row per distinct target from here on.
        .groupBy("logical_name")
        .agg(F.array_sort(F.collect_list(F.struct("first", "next_target"))).alias("_added"))
    )
    nothing = F.array().cast("array<string>")
    return bases.join(added, "logical_name", "left").select(
        "logical_name", "state", "read_target",
        F.concat(F.coalesce("_base_writes", nothing), F.coalesce(F.col("_added.next_target"), nothing)).alias("write_targets"),
        "rollback_target", "task_id", "last_verify_at", "last_verify_result", "last_cutover_at", "note", "updated_at",
    )


def _base_targets(base: Column, rollback_target: Column) -> list[Column]:
    kind = base.getField("event")
    read = (
        F.when(kind == "cutover", base.getField("next_target"))
        .when(kind == "rollback", rollback_target)
        .otherwise(base.getField("read_target"))
    )
    writes = F.when(kind.isin("cutover", "rollback"), F.array(read)).otherwise(base.getField("write_targets"))
    return [read.alias("read_target"), writes.alias("_base_writes")]


def compact(events: DataFrame) -> DataFrame:
    """The few events of each collection that decide its state: ``current_state`` of them is the same.

    Compacting is free of order: what is kept of two parts of a log, put together and compacted, is what is kept of the whole.
    For that every dual write behind the newest base stays, not the first of each target alone, as a base that is
    seen later may lie between two of them.
    """
    eid, event = F.col("event_id"), F.col("event")
    row = F.struct(*[c for c in events.columns if c != "logical_name"])
    origin = event.isin(*ORIGINS) & F.coalesce("rollback_target", "read_target").isNotNull()
    picked = events.groupBy("logical_name").agg(
        F.max_by(row, eid).alias("a"),
        F.max_by(row, F.when(event.isin(*BASES), eid)).alias("b"),
        F.min_by(row, F.when(origin, eid)).alias("c"),
        F.max_by(row, F.when(F.col("task_id").isNotNull(), eid)).alias("d"),
        F.max_by(row, F.when(event == "verify", eid)).alias("e"),
        F.max_by(row, F.when(event == "cutover", eid)).alias("f"),
    )
    singles = picked.select("logical_name", F.explode(F.array_compact(F.array("a", "b", "c", "d", "e", "f"))).alias("r"))
    base = picked.select("logical_name", F.col("b.event_id").alias("_base_id"))
    duals = (
        events.filter((event == "dual_write") & F.col("next_target").isNotNull())
        .join(base, "logical_name")
        .filter(F.col("_base_id").isNull() | (eid > F.col("_base_id")))
        .select("logical_name", row.alias("r"))
    )
    return singles.unionByName(duals).select("logical_name", "r.*").select(*events.columns).distinct()


def recent_events(events: DataFrame, limit: int = RECENT) -> DataFrame:
    """The newest events of each collection, at most ``limit`` (clamped to 1..200)."""
    return newest(events, ["logical_name"], F.col("event_id").desc(), max(1, min(limit, RECENT_MAX)))


# --- target resolution ----------------------------------------------------------------------------------


def resolve_targets(requests: DataFrame, states: DataFrame, logical: DataFrame) -> DataFrame:
    """Add ``read_target``, ``write_targets`` and ``reason`` to rows with a ``collection``.

    A name that is no logical collection is its own target; a logical one without targets is rejected.
    """
    known = logical.select(F.col("logical_name").alias("collection"), F.lit(True).alias("_logical"))
    state = states.select(
        F.col("logical_name").alias("collection"), F.col("read_target").alias("_read"),
        F.col("write_targets").alias("_writes"), F.lit(True).alias("_state"),
    )
    joined = requests.join(known, "collection", "left").join(state, "collection", "left")
    is_logical = F.col("_logical").isNotNull()
    name = F.col("collection")
    reason = F.when(
        is_logical & F.col("_state").isNull(), F.concat(F.lit("Unknown logical collection state: "), name)
    ).when(
        is_logical & F.coalesce(F.col("_read") == "", F.lit(True)),
        F.concat(F.lit("Logical collection '"), name, F.lit("' has no read target")),
    ).when(
        is_logical & (F.coalesce(F.size("_writes"), F.lit(0)) <= 0),
        F.concat(F.lit("Logical collection '"), name, F.lit("' has no write targets")),
    )
    return joined.withColumns(
        {
            "read_target": F.when(is_logical, F.col("_read")).otherwise(name),
            "write_targets": F.when(is_logical, F.col("_writes")).otherwise(F.array(name)),
            "reason": reason,
        }
    ).drop("_logical", "_state", "_read", "_writes")


def routing_as_of(requests: DataFrame, events: DataFrame) -> DataFrame:
    """State, read target and write targets in force when each request came.

    ``requests``: ``logical_name, at`` and any other columns; ``at`` compares with ``event_id`` (an event
    with the same number counts as earlier).  Requests and events are merged into one timeline and the last
    known values are carried forward across it, chunk by chunk, so neither a busy collection nor a long log
    ends up in one task.
    """
    carried = ["_state", "_read", "_base_writes", "_base_id", "_rollback"]
    event, eid = F.col("event"), F.col("event_id")
    is_base = event.isin(*BASES)
    base_read = F.when(event == "cutover", F.col("next_target")).when(event.isin("bootstrap", "bootstrap_sync"), F.col("read_target"))
    # The rollback target is fixed by the first event that names one.
    fixed = events.filter(event.isin("bootstrap", "bootstrap_sync")).groupBy("logical_name").agg(
        F.min_by(
            F.coalesce("rollback_target", "read_target"),
            F.when(F.coalesce("rollback_target", "read_target").isNotNull(), eid),
        ).alias("_fixed")
    )
    steps = events.join(fixed, "logical_name", "left").select(
        "logical_name", eid.alias("_at"), F.lit(0).alias("_kind"), eid.alias("_tie"), "event", "next_target",
        F.col("state").alias("_state"),
        F.when(is_base, F.coalesce(base_read, F.col("_fixed"))).alias("_read"),
        F.when(
            is_base,
            F.when(event.isin("cutover", "rollback"), F.array(F.coalesce(base_read, F.col("_fixed")))).otherwise(
                F.coalesce("write_targets", F.array().cast("array<string>"))
            ),
        ).alias("_base_writes"),
        F.when(is_base, eid).alias("_base_id"),
        F.col("_fixed").alias("_rollback"),
        F.lit(None).cast(requests.schema.simpleString()).alias("_request"),
    )
    asks = requests.select(
        "logical_name", F.col("at").alias("_at"), F.lit(1).alias("_kind"),
        F.xxhash64(F.struct(*requests.columns)).alias("_tie"), F.lit(None).cast("string").alias("event"),
        F.lit(None).cast("string").alias("next_target"),
        *[F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in carried],
        F.struct(*requests.columns).alias("_request"),
    )
    order = ["_at", "_kind", "_tie"]
    timeline = forward_fill(steps.unionByName(asks), ["logical_name"], order, carried)
    # Dual-write targets added since the base in force: one row per collection, base and distinct target.
    added = (
        timeline.filter((F.col("event") == "dual_write") & F.col("next_target").isNotNull())
        .filter(~F.coalesce(F.array_contains("_base_writes", F.col("next_target")), F.lit(False)))
        .groupBy("logical_name", F.coalesce("_base_id", F.lit(-1)).alias("_base_id"), "next_target")
        .agg(F.min("_at").alias("_from"))
        .groupBy("logical_name", "_base_id")
        .agg(F.array_sort(F.collect_list(F.struct("_from", "next_target"))).alias("_added"))
    )
    nothing = F.array().cast("array<string>")
    so_far = F.filter("_added", lambda a: a.getField("_from") <= F.col("_at"))
    answered = timeline.filter("_kind = 1").withColumn("_base_id", F.coalesce("_base_id", F.lit(-1)))
    return answered.join(added, ["logical_name", "_base_id"], "left").select(
        "_request.*", F.col("_state").alias("state"), F.col("_read").alias("read_target"),
        F.concat(
            F.coalesce("_base_writes", nothing),
            F.coalesce(F.transform(so_far, lambda a: a.getField("next_target")), nothing),
        ).alias("write_targets"),
    )


# --- bootstrap and drift --------------------------------------------------------------------------------


def logical_table(spark: SparkSession, specs: Sequence[LogicalSpec]) -> DataFrame:
    """The configured logical collections as a (small) table."""
    return spark.createDataFrame(
        [
            (s.name, list(s.read_targets), list(s.effective_write_targets), s.default_query_mode, s.next_target)
            for s in specs
        ],
        "logical_name string, read_targets array<string>, write_targets array<string>,"
        " default_query_mode string, next_target string",
    )


def bootstrap_events(logical: DataFrame, states: DataFrame) -> DataFrame:
    """Events that create missing states and bring idle ones in line with the configuration.

    Returns ``logical_name, event, state, read_target, write_targets, rollback_target, note``.
    """
    wanted = logical.select(
        "logical_name", F.get("read_targets", F.lit(0)).alias("read_target"), "write_targets"
    )
    now = states.select(
        "logical_name", F.col("state").alias("_state"), F.col("read_target").alias("_read"),
        F.col("write_targets").alias("_writes"), F.col("rollback_target").alias("_rollback"), F.lit(True).alias("_seen"),
    )
    joined = wanted.join(now, "logical_name", "left")
    missing = F.col("_seen").isNull()
    drifted = (F.coalesce("_state", F.lit("idle")) == "idle") & ~(
        F.col("_read").eqNullSafe(F.col("read_target")) & F.col("_writes").eqNullSafe(F.col("write_targets"))
    )
    return joined.filter(missing | drifted).select(
        "logical_name",
        F.when(missing, "bootstrap").otherwise("bootstrap_sync").alias("event"),
        F.lit("idle").alias("state"),
        "read_target", "write_targets",
        F.when(missing, F.col("read_target")).otherwise(F.coalesce("_rollback", "_read", "read_target")).alias("rollback_target"),
        F.when(~missing, "Aligned idle logical collection with config defaults").alias("note"),
    )


# --- verify, resume -------------------------------------------------------------------------------------


def verify_backfill(source: DataFrame, target: DataFrame, partition_key: str, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Per partition value: rows on both sides, missing, extra and differing ids.

    One join on the id, hashing the compared columns first so only (id, partition, hash) is shuffled.  A hash skips
    nulls, so each column goes in with a flag: a value that moved to another column differs.
    """
    flagged = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]

    def slim(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            F.col(key).alias("_id"), F.col(partition_key).alias(f"_p_{side}"),
            F.xxhash64(*flagged).alias(f"_h_{side}"), F.lit(1).alias(f"_in_{side}"),
        )

    both = slim(source, "s").join(slim(target, "t"), "_id", "full_outer")
    in_s, in_t = F.col("_in_s").isNotNull(), F.col("_in_t").isNotNull()

    def n(test: Column) -> Column:
        return F.count(F.when(test, 1))

    return both.groupBy(F.coalesce("_p_s", "_p_t").alias(partition_key)).agg(
        n(in_s).alias("source_count"), n(in_t).alias("target_count"), n(in_s & ~in_t).alias("missing"),
        n(in_t & ~in_s).alias("extra"), n(in_s & in_t & (F.col("_h_s") != F.col("_h_t"))).alias("differing"),
    ).withColumn("result", F.when((F.col("missing") + F.col("extra") + F.col("differing")) == 0, "ok").otherwise("mismatch"))


def after_checkpoint(source: DataFrame, events: DataFrame, logical_name: str | Column, key: str = "id") -> DataFrame:
    """Rows of ``source`` behind the ``checkpoint.last_id`` of the collection's newest checkpoint event."""
    name = F.lit(logical_name) if isinstance(logical_name, str) else logical_name
    last = (
        events.select("logical_name", "event_id", F.get_json_object("metadata", "$.checkpoint.last_id").alias("last_id"))
        .filter(F.col("last_id").isNotNull())
        .groupBy("logical_name")
        .agg(F.max_by("last_id", "event_id").alias("_last_id"))
    )
    marked = source.withColumn("_name", name).join(
        last.withColumnRenamed("logical_name", "_name"), "_name", "left"
    )
    return marked.filter(F.col("_last_id").isNull() | (F.col(key) > F.col("_last_id"))).drop("_name", "_last_id")


def logical_info(logical: DataFrame, states: DataFrame, stats: DataFrame, events: DataFrame, recent: int = 10) -> DataFrame:
    """Configuration, state, size of the read collection and the last events, by name."""
    last = recent_events(events, recent).groupBy("logical_name").agg(
        # At most ``recent`` rows per collection.
        F.reverse(F.array_sort(F.collect_list(F.struct("event_id", "event", "state")))).alias("recent_events")
    )
    sizes = stats.select(F.col("name").alias("read_target"), F.col("points_count").alias("read_points"))
    config = logical.select("logical_name", "default_query_mode", "next_target", F.col("read_targets").alias("configured_read_targets"))
    return (
        config.join(states, "logical_name").join(sizes, "read_target", "left").join(last, "logical_name", "left")
        .orderBy("logical_name")
    )
