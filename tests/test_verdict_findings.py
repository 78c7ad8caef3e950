"""Cases that once gave wrong rows: nulls that swap columns, null ordinals, missing ids and limits, idle restarts."""

from pyspark.sql import functions as F

from vecloom.operators.migration import EVENT_SCHEMA, verify_backfill
from vecloom.operators.mutate import default_id, last_wins
from vecloom.operators.search import search_requests


def test_swapped_nulls_differ(spark):
    a = spark.createDataFrame([("1", "p", "x", None)], "id string, part string, text string, lang string")
    b = spark.createDataFrame([("1", "p", None, "x")], "id string, part string, text string, lang string")
    row = verify_backfill(a, b, "part", ["text", "lang"]).first()
    assert row["differing"] == 1 and row["result"] == "mismatch"


def test_null_ordinal_keeps_the_row(spark):
    batch = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("b", 3, None)], "id string, value int, ordinal string")
    assert {(r.id, r.value) for r in last_wins(batch, "ordinal").collect()} == {("a", 1), ("b", 2)}


def test_chunks_without_text_get_their_own_ids(spark):
    chunks = spark.createDataFrame([(None, "[1]"), (None, "[2]"), ("t", "[3]")], "text string, vector string")
    ids = {r.id for r in chunks.select(default_id("c", chunks.text, F.lit(None), chunks.vector).alias("id")).collect()}
    assert len(ids) == 3


def test_limits_of_requests(spark):
    points = spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(30)], "id string, dense array<double>")
    points = points.selectExpr("*", "cast(null as struct<indices:array<bigint>,values:array<double>>) as sparse")
    requests = spark.createDataFrame([("a", "dense", None, [1.0, 0.0]), ("b", "dense", 20, [1.0, 0.0])], "query_id string, mode string, limit int, vector array<double>")
    requests = requests.selectExpr("*", "cast(null as struct<indices:array<bigint>,values:array<double>>) as sparse")
    counts = {r["query_id"]: r["count"] for r in search_requests(requests, points).groupBy("query_id").count().collect()}
    assert counts == {"a": 5, "b": 20}
