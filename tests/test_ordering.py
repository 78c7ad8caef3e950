import random

import pytest
from pyspark.sql import functions as F

from vecloom.operators.ordering import CHUNK, forward_fill, newest, number_rows, ordered_chunks


pytestmark = pytest.mark.usefixtures("many_chunks")


def skewed(spark, n=3000):
    rng = random.Random(3)
    # One key owns half of the rows; some keys are null.
    rows = [(("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])), rng.randrange(10**6), i, rng.choice([None, None, None, i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint").repartition(6)


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_hot_key_is_cut(spark):
    _, df = skewed(spark)
    chunks = ordered_chunks(df, ["k"], ["t", "id"])
    assert chunks.filter("k = 'hot'").select(CHUNK).distinct().count() > 1


def test_number_rows(spark):
    rows, df = skewed(spark)
    got = {r.id: r.row_number for r in number_rows(df, ["k"], ["t", "id"]).collect()}
    want = {r[2]: i + 1 for g in by_key(rows).values() for i, r in enumerate(g)}
    assert got == want


def test_number_rows_of_all(spark):
    rows, df = skewed(spark)
    got = {r.id: r.n for r in number_rows(df, [], ["t", "id"], "n").collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_forward_fill(spark):
    rows, df = skewed(spark)
    got = {r.id: r.v for r in forward_fill(df, ["k"], ["t", "id"], ["v"]).collect()}
    want = {}
    for group in by_key(rows).values():
        last = None
        for r in group:
            last = r[3] if r[3] is not None else last
            want[r[2]] = last
    assert got == want


def test_newest(spark):
    rows, df = skewed(spark)
    got = sorted(r.id for r in newest(df, ["k"], [F.col("t").desc(), F.col("id").desc()], 3).collect())
    assert got == sorted(r[2] for g in by_key(rows).values() for r in g[-3:])
