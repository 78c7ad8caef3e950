"""Chat formatting with linked tool calls, as Spark expressions.

Calls and results are joined by conversation and identifier; each conversation's messages are put into an order in which
every result follows its call; arguments are checked against the schema of the called tool; a message becomes one line of
canonical JSON (keys in order, no white space, no nulls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each message, with its place, its link and the state of both.

    ``messages``: conv_id, turn, role, text, call_id, name, arguments (map of strings); a call has role ``assistant`` and a
    call_id, a result has role ``tool`` and one.  ``tools``: name, required (array), kinds (map of argument to ``string``,
    ``integer``, ``number`` or ``boolean``); names are unique, as they are declared once.

    ``status`` is ``ok``, or for a call ``repeated`` (the id was used before), ``unknown_tool``, ``bad_arguments`` or
    ``unanswered``; for a result ``orphan`` (no call), ``repeated`` (answered before) or ``ok``.  ``depth`` is 1 for a
    result that waits for its call, else 0, and ``place`` numbers the messages of a conversation by the turn at which they can
    come first (a result not before its call), depth and turn.  A null turn comes last; a null conv_id is a conversation.
    Equal rows stay apart.  Other columns are not read.
    """
    rows = messages.select("conv_id", "turn", "role", "text", "call_id", "name", "arguments")
    rows = rows.withColumn("turn_order", F.coalesce("turn", F.lit(2**62)))
    is_call = (F.col("role") == "assistant") & F.col("call_id").isNotNull()
    is_result = (F.col("role") == "tool") & F.col("call_id").isNotNull()
    rows = rows.withColumn("kind", F.when(is_call, "call").when(is_result, "result").otherwise("plain"))
    # One row for each identifier: when it was first called and answered, and how often.
    when = lambda kind: F.when(F.col("kind") == kind, F.col("turn_order"))
    met = (
        rows.where("kind <> 'plain'")
        .groupBy("conv_id", "call_id")
        .agg(F.min(when("call")).alias("called"), F.min(when("result")).alias("answered"))
        .select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), "called", "answered")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call"))
    known = tools.select(F.col("name").alias("_tool"), "required", "kinds")
    linked = rows.join(met, same, "left").join(known, F.col("name") == F.col("_tool"), "left")
    first = F.row_number().over(Window.partitionBy("conv_id", "call_id", "kind").orderBy("turn_order", "text")) == 1
    linked = linked.withColumn("first", F.when(F.col("kind") != "plain", first))
    status = (
        F.when(F.col("kind") == "plain", "ok")
        .when(~F.col("first"), "repeated")
        .when((F.col("kind") == "call") & F.col("_tool").isNull(), "unknown_tool")
        .when((F.col("kind") == "call") & ~arguments_fit(F.col("arguments"), F.col("required"), F.col("kinds")), "bad_arguments")
        .when((F.col("kind") == "call") & F.col("answered").isNull(), "unanswered")
        .when((F.col("kind") == "result") & F.col("called").isNull(), "orphan")
        .otherwise("ok")
    )
    late = (F.col("kind") == "result") & F.col("called").isNotNull()
    ready = F.when(late, F.greatest("turn_order", "called")).otherwise(F.col("turn_order"))
    placed = linked.withColumn("status", status).withColumn("ready", ready).withColumn("depth", late.cast("int"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("ready", "depth", "turn_order", "role", "text"))
    return placed.withColumn("place", place).select("conv_id", "turn", "role", "text", "call_id", "name", "arguments", "kind", "status", "depth", "place")


def arguments_fit(arguments: Column, required: Column, kinds: Column) -> Column:
    """All required arguments are there, none is unknown, and each is written as its kind."""
    given = F.coalesce(F.map_keys(arguments), F.array().cast("array<string>"))
    patterns = {"integer": r"^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?$", "boolean": r"^(true|false)$"}

    def fits(name: Column) -> Column:
        kind, value = F.element_at(kinds, name), F.element_at(arguments, name)
        tested = F.when(kind == "string", value.isNotNull())
        for key, pattern in patterns.items():
            tested = tested.when(kind == key, value.rlike(pattern))
        return F.coalesce(tested, F.lit(False))

    return F.coalesce((F.size(F.array_except(required, given)) == 0) & F.forall(given, fits), F.lit(False))


def canonical_json() -> Column:
    """One message of ``link_calls`` as JSON: keys in alphabetical order at every level, nulls left out."""
    entries = F.array_sort(F.map_entries("arguments"))
    arguments = F.when(F.col("kind") == "call", F.map_from_entries(entries))
    return F.to_json(
        F.struct(
            arguments.alias("arguments"),
            F.col("call_id"),
            F.col("text").alias("content"),
            F.when(F.col("kind") == "call", F.col("name")).alias("name"),
            F.col("role"),
        ),
        {"ignoreNullFields": "true"},
    )


def format_chats(linked: DataFrame) -> DataFrame:
    """``link_calls`` with ``line``: each message as canonical JSON, to be written in the order of conv_id and place."""
    return linked.withColumn("line", canonical_json())
