"""Exact searches that skip blocks of points which cannot hold a hit.

An index is a table of points cut into blocks, and a bound for each block.  Sparse: points are cut by their largest weight, and a block
knows the largest and smallest weight of each of its terms, so no point of it can score more than the query's weights times these.
Dense: points are cut by their nearest pivot, and a block knows between which distances from the pivot its points lie; by the triangle
inequality none is nearer to a query than the query's own distance to the pivot allows.

A search works out the bound of every block for every query, scores the most promising blocks of each, and with the k-th score found there
leaves out all blocks whose bound is worse.  Hits are those of the full scan, ties included.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.functions.vectors import METRICS, metric_name
from vecloom.operators.filters import apply_filter
from vecloom.operators.scoring import BestK, DenseBlock, SparseBlock, as_array
from vecloom.operators.search import BROADCAST_NUMBERS, QUERY_NUMBERS, check_limit, ranked, weigh_by_frequency
from vecloom.session import ship_package, written
from vecloom.spec import DEFAULT_LIMIT

BLOCK = "block"
# Points of a block, about; pivots of a dense index.
BLOCK_ROWS = 50_000
PIVOTS = 64
# A query looks first into this many blocks at least, and into so many times the points it asks for.
SEEDS = 2
SEED_POINTS = 4
# Scores have six decimals, bounds are worked out in floating point.
MARGIN = 2e-6
# So many blocks are named one by one in a scan's filter.
LITERAL_BLOCKS = 1000


@dataclass(frozen=True)
class PrunedHits:
    """``hits`` as a search gives them; of ``pairs`` of a query and a block ``scored`` were looked at, of ``blocks`` blocks ``read``."""

    hits: DataFrame
    pairs: int
    scored: int
    blocks: int
    read: int


@dataclass(frozen=True)
class SparseIndex:
    """``points`` with their ``block``, stored by it; ``impacts``: ``block, index, most, least``; ``sizes``: ``block, n``."""

    points: DataFrame
    impacts: DataFrame
    sizes: DataFrame
    using: str
    blocks: int


@dataclass(frozen=True)
class DenseIndex:
    """``points`` with their ``block``, stored by it; ``rings``: ``block, n, pivot, near, far``; ``pivots`` as a matrix."""

    points: DataFrame
    rings: DataFrame
    pivots: np.ndarray
    metric: str
    using: str
    blocks: int


def _stored(points: DataFrame, path: str) -> DataFrame:
    points.repartition(BLOCK).write.mode("errorifexists").partitionBy(BLOCK).parquet(path)
    return points.sparkSession.read.schema(points.schema).parquet(path)


def _split(points: DataFrame, by: str, rows: int) -> DataFrame:
    """Number the blocks: each value of ``by`` is cut by a hash of the id into as many as its rows ask for."""
    sizes = points.groupBy(by).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    last = F.sum("_parts").over(W.orderBy(by).rowsBetween(W.unboundedPreceding, -1))
    # One row per class or pivot.
    numbered = written(sizes.withColumn("_first", F.coalesce(last, F.lit(0))), "sizes")
    dealt = points.join(F.broadcast(numbered), by)
    return dealt.withColumn(BLOCK, (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int")).drop("_parts", "_first", by)


# --- sparse ---------------------------------------------------------------------------------------------


def build_sparse_index(points: DataFrame, path: str, *, using: str = "sparse", block_rows: int = BLOCK_ROWS) -> SparseIndex:
    """Store the points that have terms under ``path``, cut by the size of their largest weight: a quarter of a doubling a class.

    The points are written first.  The filter on their terms and the class would else make the terms anew each time they read them,
    the filter below any shuffle of the points, where a small file is one task.
    """
    points = written(points, "points")
    values = F.col(using).getField("values")
    size = F.greatest(F.array_max(values), -F.array_min(values))
    # Far apart weights share the outer classes, so their number is fixed.
    place = F.when(size > 0, F.greatest(F.lit(-160), F.least(F.lit(160), F.floor(4 * F.log2(size))))).otherwise(F.lit(-161)).cast("int")
    with_terms = points.filter(F.size(F.col(using).getField("indices")) > 0).withColumn("_class", place)
    stored = _stored(_split(with_terms, "_class", block_rows), path)
    terms = stored.select(BLOCK, F.explode(F.arrays_zip(F.col(f"{using}.indices").alias("index"), F.col(f"{using}.values").alias("value"))).alias("t"))
    impacts = terms.groupBy(BLOCK, F.col("t.index").alias("index")).agg(F.max("t.value").alias("most"), F.min("t.value").alias("least"))
    sizes = written(stored.groupBy(BLOCK).agg(F.count("*").alias("n")), "sizes")
    return SparseIndex(stored, written(impacts, "impacts"), sizes, using, sizes.count())


def pruned_sparse_search(
    queries: DataFrame, index: SparseIndex, k: int = DEFAULT_LIMIT, *, filter: Mapping | None = None, statistics: DataFrame | None = None,
    broadcast_numbers: int = BROADCAST_NUMBERS,
) -> PrunedHits:
    """The hits of ``sparse_search``; ``statistics`` weighs the queries by IDF."""
    check_limit(k)
    wanted = queries.select("query_id", "sparse").filter(F.size("sparse.indices") > 0)
    if statistics is not None:
        wanted = weigh_by_frequency(wanted, statistics)
    wanted = written(
        wanted.select("query_id", F.col("sparse.indices").alias("indices"), F.col("sparse.values").cast("array<double>").alias("values")), "queries"
    )
    terms = wanted.select("query_id", F.explode(F.arrays_zip("indices", "values")).alias("t")).select("query_id", F.col("t.indices").alias("index"), F.col("t.values").alias("w"))
    # A point may lack a term, so no term takes anything off the bound.
    most = F.greatest(F.lit(0.0), F.col("w") * F.col("most"), F.col("w") * F.col("least"))
    bounds = terms.join(index.impacts, "index").groupBy("query_id", BLOCK).agg(F.sum(most).alias("bound"))
    rows = apply_filter(index.points, filter).select(
        BLOCK, F.col("id").cast("string").alias("id"), F.col(f"{index.using}.indices").alias("indices"), F.col(f"{index.using}.values").cast("array<double>").alias("values")
    )
    return _pruned(wanted, rows, written(bounds, "bounds"), index.sizes, k, SparseBlock, True, F.size("indices"), broadcast_numbers)


# --- dense ----------------------------------------------------------------------------------------------


def _distances(vectors: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """From each vector to each pivot; cosine stands for the distance of the unit vectors."""
    if metric == "manhattan":
        return np.stack([np.abs(vectors - pivot).sum(axis=1) for pivot in pivots], axis=1)
    return np.stack([np.sqrt(((vectors - pivot) ** 2).sum(axis=1)) for pivot in pivots], axis=1)


def _unit(vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return vectors
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1.0)


def _matrix(column, rows: int) -> np.ndarray:
    return as_array(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def build_dense_index(
    points: DataFrame, path: str, *, metric: str = "cosine", using: str = "dense", vector_size: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS
) -> DenseIndex:
    """Store the points whose vector has the size (and a direction, for cosine) under ``path``, cut by their nearest pivot.

    Pivots are the points whose ids have the smallest hashes; which they are only decides how much is skipped.  The dot product has no triangle
    inequality: its searches look into every block.
    """
    metric = metric_name(metric)
    spark = points.sparkSession
    ship_package(spark)
    fine = points.filter(F.size(using) == vector_size)
    if metric == "cosine":
        fine = fine.filter(F.exists(using, lambda x: x != 0))
    chosen = fine.orderBy(F.xxhash64("id"), "id").limit(pivots).select(F.col(using).cast("array<double>").alias("v")).collect()
    centers = _unit(np.array([row["v"] for row in chosen], np.float64).reshape(len(chosen), vector_size), metric)
    shared = spark.sparkContext.broadcast(centers)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                away = _distances(_unit(_matrix(batch.column(using), batch.num_rows), metric), shared.value, metric)
                nearest = away.argmin(axis=1)
                far = away[np.arange(len(nearest)), nearest]
                yield batch.append_column("_pivot", pa.array(nearest, pa.int32())).append_column("_away", pa.array(far))

    schema = T.StructType([*fine.schema.fields, T.StructField("_pivot", T.IntegerType()), T.StructField("_away", T.DoubleType())])
    placed = written(fine.mapInArrow(place, schema), "placed")
    stored = _stored(_split(placed.withColumn("_at", F.col("_pivot")), "_pivot", block_rows), path)
    rings = stored.groupBy(BLOCK).agg(F.count("*").alias("n"), F.first("_at").alias("pivot"), F.min("_away").alias("near"), F.max("_away").alias("far"))
    rings = written(rings, "rings")
    return DenseIndex(stored, rings, centers, metric, using, rings.count())


def pruned_dense_search(
    queries: DataFrame, index: DenseIndex, k: int = DEFAULT_LIMIT, *, filter: Mapping | None = None, broadcast_numbers: int = BROADCAST_NUMBERS
) -> PrunedHits:
    """The hits of ``dense_search`` for queries whose vectors have the index's size; others are an error."""
    check_limit(k)
    spark, metric, size = queries.sparkSession, index.metric, index.pivots.shape[1]
    ship_package(spark)
    wrong = F.raise_error(F.concat(F.lit(f"dense queries expect vector size {size}, got "), F.size("vector").cast("string")))
    wanted = queries.filter(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    wanted = written(wanted.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")).otherwise(wrong)), "queries")
    # One row per block.
    rings = index.rings.orderBy(BLOCK).collect()
    shared = spark.sparkContext.broadcast(
        (index.pivots, *(np.array([row[c] for row in rings]) for c in (BLOCK, "pivot", "near", "far")))
    )

    def bound(batches):
        centers, block, pivot, near, far = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n or not len(block):
                continue
            if metric == "dot":
                best = np.full((n, len(block)), np.inf)
            else:
                away = _distances(_unit(_matrix(batch.column("vector"), n), metric), centers, metric)[:, pivot.astype(int)]
                least = np.maximum(0.0, np.maximum(away - far, near - away))
                # In the order of scores: more is better.
                best = 1.0 - least**2 / 2 if metric == "cosine" else -least
            ids = batch.column("query_id").take(pa.array(np.repeat(np.arange(n), len(block))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(block, n), pa.int32()), pa.array(best.reshape(-1))], ["query_id", BLOCK, "bound"])

    schema = T.StructType([wanted.schema["query_id"], T.StructField(BLOCK, T.IntegerType()), T.StructField("bound", T.DoubleType())])
    bounds = written(wanted.mapInArrow(bound, schema), "bounds")
    rows = apply_filter(index.points, filter).select(BLOCK, F.col("id").cast("string").alias("id"), F.col(index.using).alias("vector"))
    return _pruned(
        wanted, rows, bounds, index.rings.select(BLOCK, "n"), k, lambda table: DenseBlock(table, metric), METRICS[metric], F.lit(size), broadcast_numbers
    )


# --- both -----------------------------------------------------------------------------------------------


def _pruned(queries, rows, bounds, sizes, k, make_block, larger_is_better, width: Column, broadcast_numbers: int) -> PrunedHits:
    order = W.partitionBy("query_id").orderBy(F.col("bound").desc(), BLOCK)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = bounds.join(sizes, BLOCK).select("query_id", BLOCK, "bound", F.row_number().over(order).alias("_place"), before.alias("_before"))
    placed = written(placed.withColumn("_first", (F.col("_place") <= SEEDS) | (F.col("_before") < SEED_POINTS * k)), "bounds")
    first = placed.filter("_first").select("query_id", BLOCK)
    seeds = written(_score(queries, rows, first, k, make_block, larger_is_better, width, broadcast_numbers), "seeds")
    key = F.col("score") if larger_is_better else -F.col("score")
    reached = ranked(seeds, k, larger_is_better).filter(F.col("rank") == k).select("query_id", key.alias("_kth"))
    open_ = placed.filter("not _first").join(reached, "query_id", "left")
    # A block that may hold an equal score is looked into: the tie goes by id.
    open_ = written(open_.filter(F.col("_kth").isNull() | (F.col("bound") + F.lit(MARGIN) >= F.col("_kth"))).select("query_id", BLOCK), "open")
    rest = _score(queries, rows, open_, k, make_block, larger_is_better, width, broadcast_numbers)
    read = first.unionByName(open_)
    return PrunedHits(
        ranked(seeds.unionByName(rest), k, larger_is_better), placed.count(), read.count(), sizes.count(), read.select(BLOCK).distinct().count()
    )


def _score(queries, rows, pairs, k, make_block, larger_is_better, width: Column, broadcast_numbers: int) -> DataFrame:
    """The best ``k`` of every pair of a query and a block: ``query_id, id, score``."""
    spark = rows.sparkSession
    query_type = to_arrow_type(queries.schema["query_id"].dataType)
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
    ship_package(spark)
    asked = queries.join(pairs.select("query_id").distinct(), "query_id", "left_semi").persist()
    numbers = (asked.agg(F.sum(F.greatest(width, F.lit(QUERY_NUMBERS)).cast("bigint")).alias("n")).head()["n"] or 0) + 2 * pairs.count()

    def best(table: pa.Table, batches) -> pa.Table:
        block = make_block(table)
        found, step = BestK(len(block.ids), k, larger_is_better), block.rows_at_once()
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                found.offer(np.asarray(as_array(part.column("id")).to_pylist(), dtype=object), block.scores(part))
        return found.rows(block.ids, query_type)

    if numbers > broadcast_numbers:
        asked.unpersist()
        # Each block is one group, met by slices of its queries.
        slice_ = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-numbers // max(1, broadcast_numbers)))))
        left = pairs.join(queries, "query_id").withColumn("_slice", slice_)
        cells = written(left.select(BLOCK, "_slice").distinct(), "cells")
        right = rows.join(cells, BLOCK)

        def cell(query_table: pa.Table, point_table: pa.Table) -> pa.Table:
            return best(query_table, point_table.to_batches()) if query_table.num_rows else best(query_table, [])

        return left.groupBy(BLOCK, "_slice").cogroup(right.groupBy(BLOCK, "_slice")).applyInArrow(cell, schema)
    table = asked.toArrow().combine_chunks()
    asked.unpersist()
    place = {value: at for at, value in enumerate(table.column("query_id").to_pylist())}
    of_block: dict[int, list[int]] = {}
    for row in pairs.toLocalIterator():
        of_block.setdefault(row[BLOCK], []).append(place[row["query_id"]])
    shared = spark.sparkContext.broadcast((table, of_block))
    named = sorted(of_block)
    if len(named) <= LITERAL_BLOCKS:
        wanted = rows.filter(F.col(BLOCK).isin(named))
    else:
        wanted = rows.join(F.broadcast(pairs.select(BLOCK).distinct()), BLOCK, "left_semi")

    def scan(batches):
        queries_, by_block = shared.value
        kept: dict[int, tuple] = {}
        for batch in batches:
            held = as_array(batch.column(BLOCK)).to_numpy(zero_copy_only=False)
            for number in np.unique(held):
                asks = by_block.get(int(number))
                if asks is None:
                    continue
                if number not in kept:
                    block = make_block(queries_.take(pa.array(asks)))
                    kept[number] = block, BestK(len(block.ids), k, larger_is_better)
                block, found = kept[number]
                points, step = batch.filter(pa.array(held == number)), block.rows_at_once()
                for start in range(0, points.num_rows, step):
                    part = points.slice(start, step)
                    found.offer(np.asarray(as_array(part.column("id")).to_pylist(), dtype=object), block.scores(part))
        for block, found in kept.values():
            yield from found.rows(block.ids, query_type).to_batches()

    return wanted.mapInArrow(scan, schema)
