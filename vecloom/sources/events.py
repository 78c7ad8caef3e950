"""The migration event log at rest: append-only Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vecloom.operators.migration import EVENT_SCHEMA
from vecloom.session import written


def read_events(spark: SparkSession, path: str) -> DataFrame:
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def append_events(events: DataFrame, path: str) -> DataFrame:
    """Append events that already have their ``event_id``; returns what was written."""
    shaped = _shaped(events)
    shaped.write.mode("append").parquet(path)
    return shaped


def append_new(events: DataFrame, path: str, order: str = "logical_name") -> DataFrame:
    """Append a handful of fresh events (a configuration's worth), numbered after the newest stored one.

    For bulk loads give the ids yourself and use ``append_events``.
    """
    spark = events.sparkSession
    newest = read_events(spark, path).agg(F.max("event_id").alias("n")).head()["n"]
    start = -1 if newest is None else newest
    numbered = events.withColumn("event_id", F.row_number().over(W.orderBy(order)).cast("bigint") + F.lit(start))
    # Fixed before it is written: the table being appended to was read to number it.
    fixed = written(_shaped(numbered), "events")
    fixed.write.mode("append").parquet(path)
    return fixed


def _shaped(events: DataFrame) -> DataFrame:
    schema = events.sparkSession.createDataFrame([], EVENT_SCHEMA).schema
    return events.select(
        *[
            (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
