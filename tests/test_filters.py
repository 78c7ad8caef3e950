import datetime as dt

import pytest
from pyspark.sql import functions as F

from vecloom.operators.filters import apply_filter, compile_filter


@pytest.fixture(scope="module")
def points(spark):
    rows = [
        ("a", "north", True, 0.9, [1, 2], dt.datetime(2021, 3, 9, 10), "2021-03-09T07:30:00Z", '{"kind": "wind", "n": 3, "tags": ["x", "y"], "deep": {"k": true}}'),
        ("b", "north", False, 0.4, [3], dt.datetime(2021, 2, 1), "2021-03-10T07:30:00Z", '{"kind": "rain", "n": "3", "at": "2021-03-09T07:30:00Z"}'),
        ("c", "south", None, 0.7, None, dt.datetime(2021, 8, 1), None, None),
        ("d", None, True, None, [], None, "not a time", '{"n": 2.5}'),
    ]
    return spark.createDataFrame(
        rows, "id string, station string, manned boolean, level double, tags array<int>, at timestamp, iso string, extra string"
    )


def ids(df):
    return "".join(sorted(r.id for r in df.select("id").collect()))


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        (None, "abcd"),
        ({}, "abcd"),
        ({"must": []}, "abcd"),
        ({"station": "north"}, "ab"),
        ({"station": ["north", "south"], "manned": True}, "a"),
        ({"must": [{"key": "level", "range": {"gte": 0.5}}]}, "ac"),
        ({"must": [{"key": "level", "range": {"gt": 0.4, "lt": 0.9}}]}, "c"),
        ({"must": [{"key": "level", "match": 0.9, "range": {"lt": 0.5}}]}, "b"),
        ({"must_not": [{"key": "station", "match": "north"}]}, "cd"),
        ({"should": [{"key": "station", "match": "south"}, {"key": "manned", "match": True}]}, "acd"),
        ({"must": [{"key": "manned", "match": True}], "should": [{"key": "level", "range": {"gte": 0.5}}]}, "a"),
        ({"must": [{"key": "station", "match": "north"}], "manned": True}, "ab"),
        ({"tags": 2}, "a"),
        ({"tags": [2, 3]}, "ab"),
        ({"must": [{"key": "at", "range": {"gte": "2021-03-09T08:15:30Z"}}]}, "ac"),
        ({"must": [{"key": "at", "range": {"gte": "2021-03-09T12:00:00+02:00"}}]}, "ac"),
        ({"must": [{"key": "at", "range": {"gt": "2021-03-09T12:00:00+02:00"}}]}, "c"),
        ({"must": [{"key": "iso", "range": {"lt": "2021-03-10T00:00:00Z"}}]}, "a"),
        ({"level": "0.9"}, ""),
        ({"manned": 1}, ""),
        ({"nowhere": 1}, ""),
        ({"must_not": [{"key": "nowhere", "match": 1}]}, "abcd"),
        ({"kind": "wind"}, "a"),
        ({"n": 3}, "a"),
        ({"n": "3"}, "b"),
        ({"n": [2.5, 3]}, "ad"),
        ({"must": [{"key": "n", "range": {"gte": 2.5}}]}, "ad"),
        ({"must": [{"key": "at2", "range": {"gte": "2021-01-01T00:00:00Z"}}]}, ""),
        ({"deep.k": True}, "a"),
        ({"extra_missing": "x", "kind": "wind"}, ""),
    ],
)
def test_filter(points, spec, expected):
    assert ids(apply_filter(points, spec)) == expected


def test_json_arrays(points):
    plain = points.drop("tags")
    assert ids(apply_filter(plain, {"tags": "y"})) == "a"
    assert ids(apply_filter(plain.drop("at"), {"must": [{"key": "at", "range": {"lte": "2021-03-09T07:30:00Z"}}]})) == "b"


@pytest.mark.parametrize(
    "spec", [{"must": [{"match": 1}]}, {"must": [{"should": []}]}, {"must": ["x"]}, {"must": [{"key": "level"}]}, {"must": [{"key": "level", "range": {"above": 1}}]}]
)
def test_unsupported(points, spec):
    with pytest.raises(ValueError):
        compile_filter(spec, points.schema)


def test_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 7).alias("label"), F.lit("x").alias("wide")).write.parquet(path)
    df = apply_filter(spark.read.parquet(path), {"must": [{"key": "label", "match": [1, 2]}, {"key": "id", "range": {"gte": 5}}]}).select("id")
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(label, [1,2])" in plan and "GreaterThanOrEqual(id,5)" in plan and "wide" not in plan.split("ReadSchema")[1].split("\n")[0]
