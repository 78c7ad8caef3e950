"""Requests that each name their own collection, filter, mode and limit, answered with one scan of each collection.

The distinct filters of a collection's requests become one bit each.  The scan computes the bits of a point once, whatever the
number of requests, and hands the points with their bits, dense and sparse vectors to the block kernel, where the bit of a request's
filter decides which points count for it.  Points no request can want are left out by the scan itself.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.functions.vectors import METRICS, metric_name
from vecloom.operators.embed import Embedder, embed_by_model, embed_texts, select_models
from vecloom.operators.filters import compile_filter
from vecloom.operators.scoring import BestK, DenseBlock, SparseBlock, as_array
from vecloom.operators.search import (
    BROADCAST_NUMBERS,
    RRF_K,
    block_scan,
    merge_branches,
    mode_rules,
    ranked,
    resolve_mode,
    term_statistics,
    text_queries,
    weigh_by_frequency,
)
from vecloom.operators.validate import Rule, model_rules, split
from vecloom.session import written
from vecloom.spec import DEFAULT_LIMIT, MAX_LIMIT, SEARCH_MODES, Catalog, CollectionSpec

# Filters looked at in one scan, 64 to a number; more distinct filters of one collection take further scans.
FILTERS_AT_ONCE = 256
WORD = 64


@dataclass(frozen=True)
class Served:
    """A collection that requests may name: its points, its shape, and its stored term counts if it weighs by IDF."""

    points: DataFrame
    spec: CollectionSpec
    statistics: DataFrame | None = None


def service_rules(collections: Mapping[str, Served]) -> list[Rule]:
    """What is wrong with a request, before its mode is known."""
    limit = F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT))
    mode = F.lower(F.coalesce("search_mode", F.lit("auto")))
    rules: list[Rule] = [
        (F.col("text").isNull() & F.col("query_text").isNull() & F.col("vector").isNull(), F.lit("One of 'text', 'query_text', or 'vector' is required")),
        ((limit < 1) | (limit > MAX_LIMIT), F.lit(f"'limit' must be between 1 and {MAX_LIMIT}")),
        (~mode.isin(*SEARCH_MODES), F.lit("'search_mode' must be one of: auto, dense, sparse, hybrid")),
        (~F.col("target").isin(*collections), F.concat(F.lit("Unknown collection: "), F.coalesce("target", F.lit("")))),
    ]
    for name, served in collections.items():
        of = (F.col("target") == name) & F.col("vector").isNotNull()
        size = served.spec.vector_size
        reason = F.concat(F.lit(f"Collection '{name}' expects dense vector size {size}, got "), F.size("vector").cast("string"))
        rules.append((of & (F.size("vector") != size), reason))
    return rules


def search_service(
    requests: DataFrame,
    collections: Mapping[str, Served],
    *,
    routing: DataFrame | None = None,
    embedders: Mapping[str, Embedder] | None = None,
    catalog: Catalog | None = None,
    rrf_k: int = RRF_K,
    broadcast_numbers: int = BROADCAST_NUMBERS,
    filters_at_once: int = FILTERS_AT_ONCE,
) -> tuple[DataFrame, DataFrame]:
    """``(hits, rejected)``: ``query_id, collection, mode, rank, id, score``, and ``query_id, reason``.

    ``requests``: ``query_id, collection, text, query_text, vector, search_mode, limit, filter`` (JSON; null or ``{}`` for none).  ``collections``:
    physical collections by name.  ``routing``: ``logical_name, read_target, default_mode`` for names that stand for them.
    ``embedders`` make the missing vectors of requests that are not sparse: by physical collection, or, with a ``catalog``, by model, where a request's
    own ``model`` (if there is such a column) comes before those of its collections.  A null limit is the default one.
    A filter that is no JSON object, or one that cannot be compiled, rejects its requests.  Equal scores are ordered by id.
    """
    routed = _routed(requests, routing)
    valid, rejected = split(routed, service_rules(collections))
    asked = text_queries(valid.withColumn("has_sparse", F.col("target").isin([n for n, c in collections.items() if c.spec.sparse_column])))
    asked = asked.withColumns({"has_terms": F.col("sparse").isNotNull(), "has_dense": F.col("vector").isNotNull()})
    if embedders:
        able = F.col("dense_text").isNotNull() if catalog else F.col("target").isin(*embedders)
        asked = asked.withColumn("has_dense", F.col("has_dense") | able)
    # What is sparse by its own choice is not embedded: it may end up dense only with a vector of its own.
    own = F.lower(F.coalesce("search_mode", F.lit("auto")))
    sparse_first = F.when(own != "auto", own).otherwise(F.col("default_mode")) == "sparse"
    asked = asked.withColumn("has_dense", F.when(F.coalesce(sparse_first, F.lit(False)), F.col("vector").isNotNull()).otherwise(F.col("has_dense")))
    ready, without = split(resolve_mode(asked), mode_rules())
    reasons = [rejected.select("query_id", "reason"), without.select("query_id", "reason")]
    if catalog:
        ready, unfit = _embedded_by_model(ready, embedders or {}, catalog)
        reasons.append(unfit)
    else:
        ready = _embedded(ready, embedders or {})
    # Written: read once for its filters and once for each collection.
    ready = written(ready, "requests")
    spread, broken = _filters(ready, collections, filters_at_once)
    if broken:
        table = requests.sparkSession.createDataFrame(broken, "target string, filter string, reason string")
        reasons.append(ready.join(F.broadcast(table), ["target", "filter"]).select("query_id", "reason"))
    hits = []
    for name, served in collections.items():
        for group in spread.get(name, []):
            hits.append(_scan(ready, name, served, group, broadcast_numbers))
    rejects = reduce(DataFrame.unionByName, reasons)
    limits = ready.select("query_id", "collection", "mode", F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).cast("bigint").alias("limit"))
    if not hits:
        none = limits.withColumns({"rank": F.lit(0).cast("bigint"), "id": F.lit(""), "score": F.lit(0.0)}).filter(F.lit(False))
        return none.select("query_id", "collection", "mode", "rank", "id", "score"), rejects
    # Each branch of a request is ranked and cut to the request's own limit.
    branches = [reduce(DataFrame.unionByName, hits).filter(F.col("branch") == b) for b in ("dense", "sparse")]
    best = [ranked(b.select("query_id", "id", F.col("key").alias("score"), "shown"), MAX_LIMIT, keep=("shown",)) for b in branches]
    merged = reduce(DataFrame.unionByName, best).drop("score").withColumnRenamed("shown", "score").join(limits, "query_id").filter("rank <= limit")
    answers = merge_branches(merged.drop("collection"), rrf_k).join(limits.select("query_id", "collection"), "query_id")
    return answers.select("query_id", "collection", "mode", "rank", "id", "score"), rejects


def _routed(requests: DataFrame, routing: DataFrame | None) -> DataFrame:
    if routing is None:
        return requests.withColumns({"target": F.col("collection"), "default_mode": F.lit(None).cast("string")})
    names = routing.select(F.col("logical_name").alias("_name"), F.col("read_target").alias("_target"), "default_mode")
    joined = requests.join(names, F.col("collection") == F.col("_name"), "left")
    return joined.withColumn("target", F.when(F.col("_name").isNotNull(), F.col("_target")).otherwise(F.col("collection"))).drop("_name", "_target")


def _embedded(ready: DataFrame, embedders: Mapping[str, Embedder]) -> DataFrame:
    done = ready.withColumn("vector", F.col("vector").cast("array<double>"))
    for name, embedder in embedders.items():
        missing = (F.col("target") == name) & F.col("vector").isNull() & F.col("mode").isin("dense", "hybrid")
        done = embed_texts(done, "dense_text", embedder, into="_made", keep=missing)
        done = done.withColumn("vector", F.coalesce("vector", F.col("_made").cast("array<double>"))).drop("_made")
    return done


def _embedded_by_model(ready: DataFrame, embedders: Mapping[str, Embedder], catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """Requests with the vectors their models make, and those whose model does not fit the collection or is not there."""
    columns = ready.columns
    ready = ready.withColumn("vector", F.col("vector").cast("array<double>"))
    missing = F.col("vector").isNull() & F.col("mode").isin("dense", "hybrid")
    named = ready.withColumn("asked_model", F.col("model") if "model" in columns else F.lit(None).cast("string"))
    chosen = select_models(named.withColumn("physical", F.col("target")), catalog, "query")
    fit, unfit = split(chosen.filter(missing), model_rules(catalog, "query"))
    # Written: the models see each text once.
    made = written(embed_by_model(fit, "dense_text", embedders, catalog.models, into="_made"), "embedded")
    done = made.filter("reason is null").withColumn("vector", F.col("_made").cast("array<double>")).select(*columns)
    bad = unfit.select("query_id", "reason").unionByName(made.filter("reason is not null").select("query_id", "reason"))
    return ready.filter(~missing).select(*columns).unionByName(done), bad


def _filters(ready: DataFrame, collections: Mapping[str, Served], at_once: int):
    """Per collection groups of ``(text, spec)`` of distinct filters, and ``(target, text, reason)`` of those that are no filters.

    Each distinct filter is an expression of the scan's plan, so they come to the driver, in groups of bounded size.
    """
    found: dict[str, list[list[tuple]]] = {}
    broken = []
    for row in ready.select("target", "filter").distinct().orderBy("target", "filter").toLocalIterator():
        try:
            spec = json.loads(row["filter"]) if row["filter"] is not None else {}
            if spec is not None and not isinstance(spec, Mapping):
                raise ValueError("a filter must be an object")
            compile_filter(spec, collections[row["target"]].points.schema)
        except (ValueError, TypeError, AttributeError) as error:
            broken.append((row["target"], row["filter"], f"'filter' is not valid: {error}"))
            continue
        groups = found.setdefault(row["target"], [[]])
        if len(groups[-1]) == at_once:
            groups.append([])
        groups[-1].append((row["filter"], spec))
    return found, broken


def mask_columns(points: DataFrame, specs: Sequence[Mapping | None]) -> tuple[Column, Column | None]:
    """The bits of all filters as an array of 64-bit numbers, and a test that holds where any filter does (None: everywhere)."""
    tests = [F.coalesce(compile_filter(spec, points.schema), F.lit(False)) for spec in specs]
    words = []
    for start in range(0, len(tests), WORD):
        # The last bit is the sign.
        bits = [F.when(test, F.lit(1 << i if i < WORD - 1 else -(1 << i))).otherwise(F.lit(0)) for i, test in enumerate(tests[start : start + WORD])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), [bit.cast("bigint") for bit in bits]))
    return F.array(*words), reduce(or_, tests) if all(specs) else None


def _scan(ready: DataFrame, name: str, served: Served, group: list[tuple], broadcast_numbers: int) -> DataFrame:
    """Candidates ``query_id, branch, id, key, shown`` of the requests of one collection whose filters are in the group."""
    spec, spark = served.spec, ready.sparkSession
    texts = spark.createDataFrame([(text, bit) for bit, (text, _) in enumerate(group)], "_filter string, bit int")
    mine = ready.filter(F.col("target") == name).join(F.broadcast(texts), F.col("filter").eqNullSafe(F.col("_filter")))
    sparse = F.col("mode").isin("sparse", "hybrid")
    mine = mine.select(
        "query_id", "bit", F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).cast("int").alias("limit"),
        F.when(F.col("mode").isin("dense", "hybrid"), F.col("vector")).alias("vector"), F.when(sparse, F.col("sparse")).alias("sparse"),
    )
    if spec.idf:
        terms = mine.select("query_id", "sparse").filter(F.col("sparse").isNotNull())
        statistics = served.statistics
        if statistics is None:
            statistics = term_statistics(served.points, terms.select(F.explode("sparse.indices").alias("index")).distinct(), spec.sparse_column)
        weighed = weigh_by_frequency(terms, statistics)
        mine = mine.drop("sparse").join(weighed, "query_id", "left")
    mine = mine.select(
        "query_id", "bit", "limit", "vector", F.col("sparse.indices").alias("indices"), F.col("sparse.values").cast("array<double>").alias("values")
    )
    mask, wanted = mask_columns(served.points, [spec_ for _, spec_ in group])
    points = served.points if wanted is None else served.points.filter(wanted)
    column = spec.sparse_column
    has_sparse = column is not None and column in served.points.columns
    rows = points.select(
        F.col("id").cast("string").alias("id"), F.col(spec.dense_column).alias("vector"), mask.alias("mask"),
        (F.col(f"`{column}`.indices") if has_sparse else F.lit(None)).cast("array<int>").alias("indices"),
        (F.col(f"`{column}`.values") if has_sparse else F.lit(None)).cast("array<double>").alias("values"),
    )
    metric = metric_name(spec.distance)
    sign = 1.0 if METRICS[metric] else -1.0
    query_type, size = to_arrow_type(ready.schema["query_id"].dataType), spec.vector_size

    def answer(query_table: pa.Table, batches) -> pa.Table:
        return _answer(query_table, batches, metric, size, query_type)

    out = [T.StructField("branch", T.StringType()), T.StructField("id", T.StringType()), T.StructField("key", T.DoubleType())]
    width = F.coalesce(F.size("vector"), F.lit(0)) + F.coalesce(F.size("indices"), F.lit(0))
    found = block_scan(mine, rows, F.greatest(width, F.lit(0)), answer, out, broadcast_numbers)
    shown = F.when(F.col("branch") == "dense", F.col("key") * F.lit(sign) + F.lit(0.0)).otherwise(F.col("key"))
    return found.withColumn("shown", shown)


def _answer(queries: pa.Table, batches, metric: str, size: int, query_type: pa.DataType) -> pa.Table:
    """Both branches of a block of requests over a stream of points."""
    branches = []
    for branch, column in (("dense", "vector"), ("sparse", "indices")):
        own = queries.filter(pc.is_valid(queries.column(column)))
        if own.num_rows:
            block = DenseBlock(own, metric) if branch == "dense" else SparseBlock(own)
            bit = np.asarray(own.column("bit").to_pylist())
            best = BestK(len(block.ids), max(own.column("limit").to_pylist()), METRICS[metric] if branch == "dense" else True)
            branches.append((branch, column, block, bit, best))
    for batch in batches:
        for branch, column, block, bit, best in branches:
            lists = as_array(batch.column(column))
            there = pc.equal(pc.list_value_length(lists), size) if branch == "dense" else pc.greater(pc.list_value_length(lists), 0)
            points = batch.filter(pc.fill_null(there, False))
            step = block.rows_at_once()
            for start in range(0, points.num_rows, step):
                part = points.slice(start, step)
                mask = as_array(part.column("mask")).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).view(np.uint64)
                counts = (mask[:, bit // WORD] >> (bit % WORD).astype(np.uint64)) & np.uint64(1)
                scores = np.where(counts.T == 1, block.scores(part), np.nan)
                best.offer(np.asarray(as_array(part.column("id")).to_pylist(), dtype=object), scores)
    found = []
    for branch, _, block, _, best in branches:
        rows = best.rows(block.ids, query_type)
        key = pc.multiply(rows.column("score"), best.sign)
        found.append(pa.table({"query_id": rows.column("query_id"), "branch": pa.array([branch] * rows.num_rows, pa.string()), "id": rows.column("id"), "key": key}))
    empty = pa.table({"query_id": pa.array([], query_type), "branch": pa.array([], pa.string()), "id": pa.array([], pa.string()), "key": pa.array([], pa.float64())})
    return pa.concat_tables([empty, *found])
