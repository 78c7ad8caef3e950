import datetime as dt
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from vecloom.operators import requestlog as r
from vecloom.spec import QueueSpec, RoutingRule

pytestmark = pytest.mark.usefixtures("many_chunks")
CALLERS = ["realtime/demo", "realtime", "interactive/a", "interactive/ab", "batch/x.y", "batch/xzy", "job[1]", "a\nb", "]", "-", "^", "", "a"]


@pytest.mark.parametrize("pattern", ["realtime/*", "*", "interactive/?", "batch/x.y", "batch/x?y", "job[[]1]", "[]]", "[!a]", "[a-z]", "a*b", "[^]", "?", "[", "a[", "*[!x]y"])
def test_globs(spark, pattern):
    df = spark.createDataFrame([(c,) for c in CALLERS], "caller string")
    got = {x.caller for x in df.filter(r.matches(F.col("caller"), pattern)).collect()}
    assert got == {c for c in CALLERS if fnmatchcase(c, pattern)}


def test_route(spark):
    rules = [RoutingRule("realtime/*", "realtime", 0, "query"), RoutingRule("interactive/*", "interactive", 1, "search"), RoutingRule("realtime/special", "batch", 9, "x")]
    df = spark.createDataFrame([("realtime/special", None), ("interactive/demo", "count"), ("interactive/demo", "dance"), ("nobody", None)], "caller string, operation string")
    got = [(x.queue, x.service_priority, x.operation, x.operation_priority, x.reason) for x in r.route(df, rules).collect()]
    assert got == [
        ("realtime", 0, "query", 0, None), ("interactive", 1, "count", 1, None), ("interactive", 1, "dance", 4, None),
        (None, None, None, None, "No routing rule matched caller: nobody"),
    ]


def test_ageing(spark):
    now = dt.datetime(2026, 1, 1, 0, 1)
    rows = [(1, 3, 0, now), (2, 3, 0, now - dt.timedelta(seconds=5)), (3, 3, 0, now - dt.timedelta(seconds=4.999)), (4, 0, 0, now + dt.timedelta(seconds=9)), (5, 3, 1, now - dt.timedelta(hours=1)), (6, 3, 0, now - dt.timedelta(seconds=59))]
    df = spark.createDataFrame(rows, "request_id int, service_priority bigint, operation_priority bigint, enqueued_at timestamp")
    got = {x.request_id: (x.effective_priority, x.position) for x in r.serving_order(df, F.lit(now)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 3, 2: 2, 3: 3, 4: 0, 5: 0, 6: 0}
    assert sorted(got, key=lambda k: got[k][1]) == [6, 4, 5, 2, 3, 1]


def test_batches(spark):
    df = spark.createDataFrame([("q", i) for i in range(10)] + [("z", i) for i in range(3)], "queue string, at int").repartition(4)
    batched = r.bounded_batches(df, ["queue"], ["at"], 4)
    got = {(x.queue, x.at): x.batch_no for x in batched.collect()}
    assert got == {("q", i): i // 4 for i in range(10)} | {("z", i): 0 for i in range(3)}
    assert {x.queue: (x.batches, x["items"]) for x in r.batch_metrics(batched, ["queue"]).collect()} == {"q": (3, 10), "z": (1, 3)}


def test_parts_round_trip(spark):
    df = spark.createDataFrame([(7, ["a", "b", "c", "d", "e"]), (8, ["x"])], "request_id int, texts array<string>")
    parts = r.split_parts(r.explode_texts(df), 2)
    done = parts.select("request_id", "part", "offset", (F.col("position") - F.col("offset")).alias("index"), F.upper("text").alias("result"))
    got = sorted((x.request_id, x.position, x.result) for x in r.reassemble(done).collect())
    assert got == [(7, i, c) for i, c in enumerate("ABCDE")] + [(8, 0, "X")]


def test_metrics(spark):
    df = spark.createDataFrame([("a", 10, 1, False), ("a", 11, None, True), ("a", 11, 1, False), ("b", 5, 0, False)], "endpoint string, latency_ms int, queue_wait_ms int, failed boolean")
    got = {x.endpoint: (x.requests, x.failures, x.avg_latency_ms, x.avg_queue_wait_ms) for x in r.endpoint_metrics(df).collect()}
    assert got == {"a": (3, 1, 10.67, 0.67), "b": (1, 0, 5.0, 0.0)}


def test_depth(spark):
    pending = spark.createDataFrame([("q", 3), ("q", 2), ("other", 1)], "queue string, n_texts int")
    got = {x.queue: (x.pending_requests, x.pending_texts) for x in r.queue_depth(spark, pending, [QueueSpec("q"), QueueSpec("idle")]).collect()}
    assert got == {"q": (2, 5), "idle": (0, 0)}


def test_failures(spark):
    rows = [(404, "E", "x", 404), (None, "E", "Unexpected 404 - Not found", 404), (500, "ReadTimeout", "", 504), (None, None, "timed out", 504), (None, None, None, 502)]
    df = spark.createDataFrame(rows, "s int, c string, m string, want int")
    for x in df.withColumn("got", r.failure_status(F.col("s"), F.col("c"), F.col("m"))).collect():
        assert x.got == x.want
