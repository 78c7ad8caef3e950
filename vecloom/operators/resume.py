"""Resume a backfill whose slices end in any order: what is finished is a union of id ranges, what is open are its gaps.

A slice covers the ids behind ``after_id`` up to and with ``last_id``; null is the beginning.  Slices that overlap or are finished twice
do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators.ordering import forward_fill, running_max
from vecloom.session import written

# Up to this many open ranges are sent to the scan of the source.
BROADCAST_RANGES = 10_000


def finished_slices(events: DataFrame) -> DataFrame:
    """``logical_name, after_id, last_id`` of the slices that events report as ``{"slice": {"after_id": .., "last_id": ..}}``."""
    slices = events.select(
        "logical_name",
        F.get_json_object("metadata", "$.slice.after_id").alias("after_id"),
        F.get_json_object("metadata", "$.slice.last_id").alias("last_id"),
    )
    return slices.filter(F.col("last_id").isNotNull() & (F.col("after_id").isNull() | (F.col("after_id") < F.col("last_id")))).distinct()


def open_ranges(slices: DataFrame, key: str = "logical_name") -> DataFrame:
    """``key, after_id, until_id`` of what no slice covers; the last range of each collection has no end (null).

    In the order of their beginnings a slice leaves a gap before it if it begins behind the end of all earlier ones.  That
    end is a running maximum over range chunks, so the slices of a busy collection are spread over tasks.
    """
    slices = written(slices.select(key, "after_id", "last_id"), "slices")
    reached = running_max(slices, [key], ["after_id", "last_id"], "last_id", "_reached")
    gap = F.col("after_id").isNotNull() & F.coalesce(F.col("after_id") > F.col("_reached"), F.lit(True))
    gaps = reached.filter(gap).select(key, F.col("_reached").alias("after_id"), F.col("after_id").alias("until_id"))
    tails = slices.groupBy(key).agg(F.max("last_id").alias("after_id")).withColumn("until_id", F.lit(None).cast("string"))
    return written(gaps.unionByName(tails), "open")


def progress(ranges: DataFrame, key: str = "logical_name") -> DataFrame:
    """``key, prefix_id, gaps``: the id up to which nothing is open (null: none), and how many gaps lie behind it."""
    first = F.min(F.struct(F.col("after_id").isNotNull().alias("later"), F.col("after_id")))
    found = ranges.groupBy(key).agg(first.alias("first"), F.count("until_id").alias("gaps"))
    return found.select(key, F.col("first.after_id").alias("prefix_id"), "gaps")


def open_rows(
    source: DataFrame, ranges: DataFrame, name: str | Column, *, key: str = "logical_name", id: str = "id", broadcast_ranges: int = BROADCAST_RANGES
) -> DataFrame:
    """The rows of ``source`` that no finished slice covers; a collection without slices is open as a whole, and a null name is one.

    ``name`` tells the collection of a row.  A few ranges go to the scan; many are merged with the rows into one line, in
    order of the ids, along which the last range that began is carried forward.
    """
    name = F.lit(name) if isinstance(name, str) else name
    rows = source.withColumn("_name", name)
    ranges = ranges.select(F.col(key).alias("_name"), "after_id", "until_id")

    def inside(one: Column) -> Column:
        begun = one["after_id"].isNull() | (F.col(id) > one["after_id"])
        return begun & (one["until_id"].isNull() | (F.col(id) <= one["until_id"]))

    if ranges.count() <= broadcast_ranges:
        gathered = ranges.groupBy(F.col("_name").alias("_of")).agg(F.collect_list(F.struct("after_id", "until_id")).alias("_ranges"))
        found = rows.join(F.broadcast(gathered), F.col("_name").eqNullSafe(F.col("_of")), "left")
        return found.filter(F.col("_ranges").isNull() | F.exists("_ranges", inside)).select(*source.columns)
    whole = F.struct(*source.columns)
    # A mark in front of every collection that has ranges: until one begins, its rows are done.
    marks = ranges.select("_name").distinct().select("_name", F.lit(None).cast("string").alias("_at"), F.lit(0).alias("_kind"), _range(False))
    starts = ranges.select("_name", F.col("after_id").alias("_at"), F.lit(2).alias("_kind"), _range(True, F.col("after_id"), F.col("until_id")))
    none = F.lit(None).cast(source.schema.simpleString())
    line = marks.unionByName(starts).withColumn("_row", none).withColumn("_tie", F.lit(0).cast("bigint"))
    own = rows.select(
        "_name", F.col(id).cast("string").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<open:boolean,after_id:string,until_id:string>").alias("_range"),
        whole.alias("_row"), F.xxhash64(whole).alias("_tie"),
    )
    # A range begins behind its ``after_id``, so rows of that id come first.
    filled = forward_fill(line.unionByName(own), ["_name"], ["_at", "_kind", "_tie"], ["_range"]).filter("_kind = 1")
    last = F.col("_range")
    still = last.isNull() | (last["open"] & (last["until_id"].isNull() | (F.col("_at") <= last["until_id"])))
    return filled.filter(still).select("_row.*")


def _range(is_open: bool, after: Column | None = None, until: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(is_open).alias("open"), (none if after is None else after).alias("after_id"), (none if until is None else until).alias("until_id")).alias("_range")
