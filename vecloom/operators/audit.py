"""Declared shape against stored shape, and table statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.spec import CollectionSpec


def infer_shape(df: DataFrame) -> tuple[str | None, str | None]:
    """First dense and first sparse vector column of a table that was never registered."""
    dense = next(
        (f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)
         and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))), None
    )
    sparse = next(
        (f.name for f in df.schema if isinstance(f.dataType, T.StructType)
         and {"indices", "values"} <= set(f.dataType.names)), None
    )
    return dense, sparse


def table_stats(name: str, df: DataFrame) -> DataFrame:
    """``(name, vector_name, sparse_vector_name, points_count, vectors_count, min_size, max_size)`` in one scan."""
    dense, sparse = infer_shape(df)
    size = F.size(F.col(dense)) if dense else F.lit(None).cast("int")
    # ``size`` of null is null here only if asked for: make it so.
    size = F.when(F.col(dense).isNotNull(), size) if dense else size
    return df.agg(
        F.count("*").alias("points_count"), F.count(size).alias("vectors_count"),
        F.min(size).alias("min_size"), F.max(size).alias("max_size"),
    ).select(
        F.lit(name).alias("name"), F.lit(dense).cast("string").alias("vector_name"),
        F.lit(sparse).cast("string").alias("sparse_vector_name"),
        "points_count", "vectors_count", F.col("min_size").cast("bigint").alias("min_size"),
        F.col("max_size").cast("bigint").alias("max_size"),
    )


def collection_stats(spark: SparkSession, tables: Mapping[str, DataFrame | Exception]) -> DataFrame:
    """One row per table; a table that could not be opened gives a status instead of failing the listing."""
    good = [table_stats(n, t).withColumn("status", F.lit("ok")) for n, t in tables.items() if isinstance(t, DataFrame)]
    schema = (
        "name string, vector_name string, sparse_vector_name string, points_count bigint, vectors_count bigint,"
        " min_size bigint, max_size bigint, status string"
    )
    failed = [(n, None, None, None, None, None, None, f"error: {t}") for n, t in tables.items() if isinstance(t, Exception)]
    if failed or not good:
        good.append(spark.createDataFrame(failed, schema))
    return reduce(DataFrame.unionByName, good)


def audit_shapes(spark: SparkSession, specs: Sequence[CollectionSpec], stats: DataFrame) -> DataFrame:
    """Compare every spec with its table: ``ok``, ``create``, ``recreate`` (empty table) or ``warn``.

    ``stats`` is ``collection_stats``, optionally with the table's ``distance``.
    """
    rows = [(s.name, s.vector_name, s.vector_size, s.distance.lower(), s.sparse_vector_name) for s in specs]
    expected = spark.createDataFrame(
        rows, "name string, want_vector string, want_size bigint, want_distance string, want_sparse string"
    )
    actual = stats if "distance" in stats.columns else stats.withColumn("distance", F.lit(None).cast("string"))
    joined = expected.join(actual, "name", "left")
    # A size of null means no vector is stored yet: nothing to disagree with.
    same = (
        F.coalesce("want_vector", F.lit("dense")).eqNullSafe(F.col("vector_name"))
        & F.col("want_sparse").eqNullSafe(F.col("sparse_vector_name"))
        & (F.coalesce("min_size", "want_size") == F.col("want_size"))
        & (F.coalesce("max_size", "want_size") == F.col("want_size"))
        & (F.coalesce(F.lower("distance"), "want_distance") == F.col("want_distance"))
    )
    action = (
        F.when(F.col("points_count").isNull(), "create")
        .when(same, "ok")
        .when(F.col("points_count") == 0, "recreate")
        .otherwise("warn")
    )
    return joined.select(
        "name", "want_vector", "want_size", "want_sparse", "vector_name", "min_size", "max_size",
        "sparse_vector_name", "points_count", action.alias("action"),
    )
