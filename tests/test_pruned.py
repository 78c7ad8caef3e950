"""Searches that skip blocks give the hits of the full scan, ties included, and do skip."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.text import sparse_terms
from vecloom.operators.pruned import build_dense_index, build_sparse_index, pruned_dense_search, pruned_sparse_search
from vecloom.operators.search import dense_search, sparse_search, term_statistics

KIND = "struct<indices: array<int>, values: array<double>>"


def rows(hits):
    return sorted(tuple(r) for r in hits.select("query_id", "rank", "id", "score").collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 10, (12, 6))
    made = [(f"p{i:04d}", (centers[i % 12] + rng.normal(0, 0.5, 6)).round(2).tolist(), i % 5) for i in range(1200)]
    # Many equal ones, zero vectors, other sizes and nulls.
    made += [(f"t{i:03d}", centers[0].round(2).tolist(), 1) for i in range(60)] + [("zero", [0.0] * 6, 1), ("short", [1.0], 1), ("none", None, 1)]
    points = spark.createDataFrame(made, "id string, dense array<double>, kind int").repartition(5)
    asked = [(f"q{i}", (centers[i] + rng.normal(0, 0.4, 6)).tolist()) for i in range(8)] + [("tie", centers[0].round(2).tolist()), ("none", None)]
    return points, spark.createDataFrame(asked, "query_id string, vector array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclid", "manhattan", "dot"])
def test_dense(spark, vectors, tmp_path, metric):
    points, queries = vectors
    index = build_dense_index(points, str(tmp_path / metric), metric=metric, vector_size=6, pivots=16, block_rows=40)
    for k, spec, numbers in ((5, None, 8_000_000), (30, {"kind": [1, 2]}, 8_000_000), (5, None, 500)):
        found = pruned_dense_search(queries, index, k, filter=spec, broadcast_numbers=numbers)
        assert rows(found.hits) == rows(dense_search(queries, points, k, filter=spec, metric=metric, vector_size=6))
        assert found.pairs == 9 * index.blocks
        if metric == "dot":
            assert found.scored == found.pairs
        elif not spec:
            assert found.scored < found.pairs / 2 and found.read <= index.blocks


def test_dense_edges(spark, vectors, tmp_path):
    points, queries = vectors
    empty = build_dense_index(points.where("false"), str(tmp_path / "e"), vector_size=6)
    assert pruned_dense_search(queries, empty, 3).hits.count() == 0
    index = build_dense_index(points, str(tmp_path / "i"), vector_size=6, pivots=4)
    assert pruned_dense_search(queries.where("false"), index, 3).hits.count() == 0
    with pytest.raises(Exception, match="expect vector size 6"):
        pruned_dense_search(spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>"), index, 3).hits.count()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    made = [(f"d{i:04d}", " ".join(rng.choices(words, k=rng.choice([2, 5, 40, 300]))), i % 3) for i in range(900)]
    made += [(f"t{i:03d}", "w1 w2 w3", 1) for i in range(50)] + [("empty", "", 1), ("none", None, 1)]
    points = spark.createDataFrame(made, "id string, text string, kind int").withColumn("sparse", sparse_terms(F.coalesce("text", F.lit("")))).drop("text")
    negative = spark.createDataFrame([("neg", ([5, 9], [-3.0, 2.0]), 1), ("neg2", ([5], [-9.0]), 1)], f"id string, sparse {KIND}, kind int").select("id", "kind", "sparse")
    asked = [(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(10)] + [("tie", "w1 w2"), ("nothing", "unknown words"), ("blank", "")]
    queries = spark.createDataFrame(asked, "query_id string, text string").withColumn("sparse", sparse_terms("text")).drop("text")
    signed = spark.createDataFrame([("minus", ([5, 9], [-1.0, 0.5])), ("plus", ([5], [2.0]))], f"query_id string, sparse {KIND}")
    return points.unionByName(negative).repartition(4), queries.unionByName(signed)


@pytest.mark.parametrize("idf", [False, True])
def test_sparse(spark, texts, tmp_path, idf):
    points, queries = texts
    index = build_sparse_index(points, str(tmp_path / "s"), block_rows=30)
    statistics = term_statistics(points) if idf else None
    for k, spec, numbers in ((5, None, 8_000_000), (40, {"kind": 1}, 8_000_000), (5, None, 1000)):
        found = pruned_sparse_search(queries, index, k, filter=spec, statistics=statistics, broadcast_numbers=numbers)
        assert rows(found.hits) == rows(sparse_search(queries, points, k, filter=spec, idf=idf, statistics=statistics))
        assert found.scored <= found.pairs and found.read <= index.blocks
    few = pruned_sparse_search(queries, index, 1, statistics=statistics)
    assert few.scored < few.pairs * 0.8


def test_building_makes_the_terms_once(spark, tmp_path):
    """Terms may be expensive: each row's are made once, not for the filter, the classes and the blocks anew."""
    made = spark.sparkContext.accumulator(0)

    @F.udf(KIND)
    def terms(n):
        made.add(1)
        return ([n % 7], [1.0 + n % 5]) if n % 10 else ([], [])

    points = spark.range(100).select(F.col("id").cast("string").alias("id"), terms("id").alias("sparse"))
    index = build_sparse_index(points, str(tmp_path / "once"), block_rows=30)
    assert index.points.count() == 90
    assert made.value == 100
