"""Request metrics per time window, while the log grows, with rows that come twice or too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from vecloom.operators.requestlog import metric_columns

# Rows are judged in this many groups at a time.
SHARDS = 8


def windowed_metrics(log: DataFrame, window: str = "1 hour", late: str = "10 minutes", *, request: str | None = None) -> DataFrame:
    """Endpoint metrics per tumbling window of ``ts``; rows later than ``late`` are dropped.

    ``request`` names the column that tells a repeated row: of its rows one counts.  A stream remembers an id for as long as its
    row's repeat would not be late.  The same on a stream and on a table.
    """
    grouped = log.withWatermark("ts", late) if log.isStreaming else log
    if request:
        grouped = grouped.dropDuplicatesWithinWatermark([request]) if log.isStreaming else grouped.dropDuplicates([request])
    return grouped.groupBy(F.window("ts", window), "endpoint").agg(*metric_columns()).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "endpoint", "requests", "failures", "avg_latency_ms", "avg_queue_wait_ms",
    )


def write_metrics(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows, each written once."""
    return (
        metrics.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def mark_late(log: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", *, shards: int = SHARDS) -> StreamingQuery:
    """Write every row of the stream ``log`` to ``path`` with ``late``: whether the watermark had reached its time when it came.

    Rows without a time are late.  Nothing is dropped: what ``read_on_time`` gives is in time for windows with the same ``late``, as their watermark
    is never ahead of this one, and ``late_rows`` has the rest.  Each micro-batch appears as a whole.
    """
    columns = log.columns
    clash = {"late", "_shard"} & set(columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be lost: rename them")
    at = columns.index("ts")

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # The state itself is empty; it knows the watermark.
        reached = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for batch in batches:
            rows = batch[columns]
            times = pd.to_datetime(rows.iloc[:, at])
            if times.dt.tz is not None:
                times = times.dt.tz_convert("UTC").dt.tz_localize(None)
            yield rows.assign(late=times.isna() | (times <= reached))

    dealt = log.withWatermark("ts", late).withColumn("_shard", F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("int"))
    schema = T.StructType([*log.schema.fields, T.StructField("late", T.BooleanType())])
    judged = dealt.groupBy("_shard").applyInPandasWithState(judge, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)
    # The writer wants rows of its own, not views into Arrow batches: a projection makes them.
    judged = judged.withColumn("late", F.coalesce("late", F.lit(True)))
    return (
        judged.writeStream.outputMode("append").format("parquet").partitionBy("late").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_on_time(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows ``mark_late`` found in time, as a stream of whole micro-batches."""
    marked = T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])
    return spark.readStream.schema(marked).parquet(path).filter("not late").drop("late")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("late").cast("boolean")).drop("late")


def late_counts(late: DataFrame, window: str = "1 hour") -> DataFrame:
    """How many rows came too late, by the window they would have been in."""
    return late.groupBy(F.window("ts", window).getField("start").alias("window_start"), "endpoint").agg(F.count("*").alias("late"))
