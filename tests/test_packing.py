"""Greedy batches of requests against a plain fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators.packing import packed_batches, transfer

pytestmark = pytest.mark.usefixtures("many_chunks")


def fold(sizes, limit, held=None):
    """Batch numbers (from -1 for a batch that was open before), and the texts of the last batch."""
    numbers, total, number = [], limit if held is None else held, -1
    for size in sizes:
        if total >= limit or total + size > limit:
            number, total = number + 1, 0
        total += size
        numbers.append(number)
    return numbers, total


@pytest.mark.parametrize("seed", range(30))
def test_transfer(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 2, 7, 30])
    sizes = [rng.choice([0, 1, 1, 2, rng.randrange(1, limit + 3)]) for _ in range(rng.choice([1, 2, 5, 60]))]
    out, begun = transfer(np.array(sizes, np.int64), limit)
    for held in range(limit + 1):
        numbers, total = fold(sizes, limit, held)
        assert (out[held], begun[held]) == (min(total, limit), numbers[-1] + 1), (sizes, limit, held)


@pytest.mark.parametrize("seed", range(4))
def test_packed_batches(spark, seed):
    rng = random.Random(seed)
    limits = {"hot": 8, "b": 3, None: 128, "one": 5}
    rows = []
    for i in range(1500):
        key = rng.choice(["hot"] * 6 + ["b", None])
        rows.append((i, key, rng.randrange(1000), rng.choice([None, 0, 1, 1, 1, 2, 3, rng.randrange(1, 12)]), "x" * 5))
    rows.append((9999, "one", 5, 70, ""))
    requests = spark.createDataFrame(rows, "request_id int, queue string, at int, n_texts int, payload string").repartition(5)
    limit = F.when(F.col("queue") == "hot", 8).when(F.col("queue") == "b", 3).when(F.col("queue") == "one", 5).otherwise(128)
    got = packed_batches(requests, ["queue"], ["at", "request_id"], "n_texts", limit)
    assert got.columns == [*requests.columns, "batch_no"]
    mine = {r["request_id"]: r["batch_no"] for r in got.collect()}
    assert len(mine) == len(rows)
    for key, top in limits.items():
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        numbers, _ = fold([r[3] or 0 for r in own], top)
        assert [mine[r[0]] for r in own] == numbers


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "request_id int, queue string, n_texts int")
    assert packed_batches(empty, ["queue"], ["request_id"], "n_texts", 4).count() == 0
    alone = spark.createDataFrame([(i, 2) for i in range(5)], "request_id int, n_texts int")
    assert sorted(r["batch_no"] for r in packed_batches(alone, [], ["request_id"], "n_texts", 4).collect()) == [0, 0, 1, 1, 2]
