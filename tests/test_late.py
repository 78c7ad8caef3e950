"""A log with repeated and late rows: the windows of the stream and the late rows together are the batch answer."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vecloom.streaming.metrics import late_counts, late_rows, mark_late, read_on_time, windowed_metrics, write_metrics

SCHEMA = "request_id long, endpoint string, ts timestamp, latency_ms long, queue_wait_ms long, failed boolean"
START = dt.datetime(2024, 5, 1)


def log_parts(seed):
    """Parts in order of arrival: time moves on, some rows lag behind, some come twice."""
    rng, parts, n, sent = random.Random(seed), [], 0, []
    for part in range(6):
        rows = []
        for _ in range(40):
            lag = rng.choice([0, 0, 0, 5, 40, 200])
            at = START + dt.timedelta(minutes=part * 60 + rng.randrange(60) - lag)
            rows.append((n, rng.choice(["search", "upsert"]), at, rng.randrange(100), rng.choice([None, 3]), rng.random() < 0.2))
            n += 1
        sent += rows
        rows += rng.sample(sent, 10)
        parts.append(rows)
    return parts


@pytest.mark.parametrize("seed", range(2))
def test_windows_and_late_rows_are_everything(spark, tmp_path, seed):
    source, marked, out = (str(tmp_path / n) for n in ("log", "marked", "out"))
    parts = log_parts(seed)
    schema = spark.createDataFrame([], SCHEMA).schema
    reached, wanted_late, seen_ids = None, [], set()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Both jobs start anew after each part, from where they were.
        stream = spark.readStream.schema(schema).parquet(source)
        mark_late(stream, marked, str(tmp_path / "m1")).awaitTermination()
        metrics = windowed_metrics(read_on_time(spark, marked, schema), request="request_id")
        write_metrics(metrics, out, str(tmp_path / "m2")).awaitTermination()
        wanted_late += [r[0] for r in rows if reached is not None and r[2] <= reached]
        latest = max(r[2] for r in rows) - dt.timedelta(minutes=10)
        reached = max(reached, latest) if reached else latest
    late = late_rows(spark, marked)
    assert sorted(r["request_id"] for r in late.collect()) == sorted(wanted_late) and wanted_late
    assert late_counts(late).agg(F.sum("late")).head()[0] == len(wanted_late)
    # Everything in time, repeats once, in windows; only the last ones are still open.
    everything = spark.createDataFrame([r for rows in parts for r in rows], SCHEMA)
    on_time = spark.read.parquet(marked).filter("late = 'false'").drop("late")
    assert on_time.count() + late.count() == everything.count()
    closed = windowed_metrics(on_time, request="request_id").filter(F.col("window_end") <= F.lit(reached))
    got = sorted(map(str, spark.read.schema(closed.schema).parquet(out).collect()))
    assert got == sorted(map(str, closed.collect())) and len(got) > 6
    # With the late rows put back, the windows are those of the whole log.
    whole = windowed_metrics(on_time.unionByName(late), request="request_id")
    assert sorted(map(str, whole.collect())) == sorted(map(str, windowed_metrics(everything, request="request_id").collect()))


def test_reserved_names(spark, tmp_path):
    stream = spark.readStream.schema("ts timestamp, late boolean").parquet(str(tmp_path))
    with pytest.raises(ValueError):
        mark_late(stream, str(tmp_path / "a"), str(tmp_path / "b"))
