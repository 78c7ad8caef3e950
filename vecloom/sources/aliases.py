"""Names that stand for tables, following the migration state: a cutover or rollback moves them with its event.

All names of a root are one small table: Parquet folders of (alias, table), and commits that list them.  The newest folder that has
a name says what it stands for, so any number of names moves by one job and one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.migration import current_state, phase_events
from vecloom.session import written
from vecloom.sources.commits import CommitLog
from vecloom.sources.events import append_new, read_events

ALIASES = "alias string, table string"
# So many folders of names are folded into one.
FOLDERS = 16


def _at(root: str) -> str:
    return f"{root.rstrip('/')}/_aliases"


def _commits(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{_at(root)}/_commits")


def _stored(spark: SparkSession, root: str, commit: tuple[int, dict] | None) -> DataFrame:
    """The names of a commit, one row for each."""
    if commit is None:
        # Names used to have a log of their own each; the first commit takes them over.
        own = [name for name in _commits(spark, root).folders(_at(root)) if name not in ("_commits", "data")]
        logs = [(name, CommitLog(spark, f"{_at(root)}/{name}").newest()) for name in own]
        return spark.createDataFrame([(name, found[1]["table"]) for name, found in logs if found], ALIASES)
    folders = [spark.read.schema(ALIASES).parquet(f"{_at(root)}/data/{folder}").withColumn("_n", F.lit(n)) for n, folder in enumerate(commit[1]["folders"])]
    rows = folders[0]
    for folder in folders[1:]:
        rows = rows.unionByName(folder)
    return rows.groupBy("alias").agg(F.max_by("table", "_n").alias("table")) if len(folders) > 1 else rows.drop("_n")


def read_aliases(spark: SparkSession, root: str) -> DataFrame:
    """All aliases that were ever set: ``(alias, table)``."""
    return _stored(spark, root, _commits(spark, root).newest())


def read_alias(spark: SparkSession, root: str, alias: str) -> str | None:
    """The table an alias stands for; None if it was never set."""
    found = read_aliases(spark, root).filter(F.col("alias") == alias).head()
    return found["table"] if found else None


def set_alias(spark: SparkSession, root: str, alias: str, table: str) -> bool:
    """Make an alias stand for a table, in one step; False if it does already."""
    return not _set(spark, root, spark.createDataFrame([(alias, table)], ALIASES)).isEmpty()


def _set(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Make aliases (one row for each) stand for their tables, all in one step; returns those that moved.

    Somebody else may set other aliases in the meantime; if one of these was set, it is an error.
    """
    commits = _commits(spark, root)
    before = commits.newest()

    def against(rows: DataFrame, commit: tuple[int, dict] | None) -> DataFrame:
        return rows.join(_stored(spark, root, commit).withColumnRenamed("table", "_now"), "alias", "left")

    moved = written(against(wanted, before).filter(~F.col("_now").eqNullSafe(F.col("table"))).withColumnRenamed("_now", "_before"), "aliases")
    new = moved.select("alias", "table")
    while not moved.isEmpty():
        folders = before[1]["folders"] if before else []
        rows = new
        fold = before is None or len(folders) + 1 >= FOLDERS
        if fold:
            rows = _stored(spark, root, before).join(new.select("alias"), "alias", "left_anti").unionByName(new)
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{_at(root)}/data/{folder}")
        try:
            commits.put({"folders": [folder] if fold else [*folders, folder]}, before[0] if before else None)
            break
        except (RuntimeError, Py4JJavaError):
            newer = commits.newest()
            if newer == before or not against(moved, newer).filter(~F.col("_now").eqNullSafe(F.col("_before"))).isEmpty():
                raise
            before = newer
    return new


def sync_aliases(spark: SparkSession, root: str, states: DataFrame, aliases: Mapping[str, str] | DataFrame) -> dict[str, str] | DataFrame:
    """Make the alias of each logical collection stand for its read target; returns those that moved.

    ``aliases`` is a part of the configuration: logical name to alias, or any number of them as a table ``(logical_name, alias)``; then
    those that moved are a table too, ``(alias, table)``.  An alias that is the name of its target, or of a collection without
    one, is left alone.  The state decides, so running this again after a failure sets what is missing.
    """
    config = aliases if isinstance(aliases, DataFrame) else spark.createDataFrame(list(aliases.items()), "logical_name string, alias string")
    pairs = states.select("logical_name", F.col("read_target").alias("table")).join(config, "logical_name")
    # An alias of several collections stands for the last one's target.
    wanted = pairs.filter(F.col("alias") != F.col("table")).groupBy("alias").agg(F.max_by("table", "logical_name").alias("table"))
    moved = _set(spark, root, wanted)
    return moved if isinstance(aliases, DataFrame) else {row["alias"]: row["table"] for row in moved.collect()}


def run_phases(
    spark: SparkSession, root: str, log_path: str, actions: DataFrame, logical: DataFrame, aliases: Mapping[str, str]
) -> tuple[dict[str, str], DataFrame]:
    """Record a handful of actions as events and bring the aliases in line: ``(aliases that moved, rejected)``.

    The event comes first.  If the job stops behind it, the next run, or ``sync_aliases``, moves the alias.
    """
    events, rejected = phase_events(actions, logical)
    # Numbered behind the log, in the order the actions ask for.
    append_new(events.withColumnRenamed("event_id", "_asked"), log_path, "_asked")
    return sync_aliases(spark, root, current_state(read_events(spark, log_path)), aliases), rejected
