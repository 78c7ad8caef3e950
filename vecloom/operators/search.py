"""Search: a table of queries against a table of points.

The reference semantics answer one request at a time; here all requests of a table share one scan of the
points.  Ranks start at 1, better first, equal scores by id.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.functions.text import bind, is_blank, sparse_or_null
from vecloom.functions.vectors import METRICS, metric_name, score as pair_score
from vecloom.operators.filters import apply_filter
from vecloom.operators.scoring import DenseBlock, SparseBlock, best_of
from vecloom.session import ship_package, written
from vecloom.spec import DEFAULT_LIMIT, MAX_LIMIT

# A query block up to this many stored numbers is broadcast (float64: 64 MB); beyond it both sides are
# cut into a grid.
BROADCAST_NUMBERS = 8_000_000
# A query counts for at least this many numbers: its running best list takes room whatever its own size.
QUERY_NUMBERS = 160
# Distinct query terms up to this many (4 bytes each) are broadcast.
BROADCAST_TERMS = 2_000_000
# Grid path: stored numbers of the point side of one cell.
CELL_NUMBERS = 32_000_000

# Reciprocal rank fusion constant (Cormack et al. 2009).
RRF_K = 60


def check_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"'limit' must be between 1 and {MAX_LIMIT}")
    return limit


# --- dense ----------------------------------------------------------------------------------------------


def dense_search(
    queries: DataFrame,
    points: DataFrame,
    k: int = DEFAULT_LIMIT,
    *,
    filter: Mapping | None = None,
    metric: str = "cosine",
    using: str = "dense",
    vector_size: int | None = None,
    broadcast_numbers: int = BROADCAST_NUMBERS,
) -> DataFrame:
    """Top ``k`` points per query: ``(query_id, rank, id, score)``.

    ``queries`` has ``query_id`` and ``vector``; ``using`` names the vector column of the points.  Vectors
    of another length than the collection's are errors on the query side and no hits on the point side.
    """
    check_limit(k)
    metric = metric_name(metric)
    wanted = queries.filter(F.col("vector").isNotNull()).select("query_id", F.col("vector"))
    if vector_size is None:
        # Without a declared size the first query vector sets it.
        first = wanted.select(F.size("vector").alias("n")).head()
        vector_size = first["n"] if first else 0
    rows = apply_filter(points, filter).filter(F.size(F.col(using)) == vector_size)
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col(using).alias("vector"))
    wrong = F.raise_error(
        F.concat(F.lit(f"dense queries expect vector size {vector_size}, got "), F.size("vector").cast("string"))
    )
    wanted = wanted.select(
        "query_id", F.when(F.size("vector") == vector_size, F.col("vector")).otherwise(wrong).alias("vector")
    )
    return _top_k(
        wanted, rows, k, F.lit(vector_size), lambda t: DenseBlock(t, metric), METRICS[metric], broadcast_numbers
    )


def dense_pairs(queries: DataFrame, points: DataFrame, metric: str = "cosine", using: str = "dense") -> DataFrame:
    """Scores of *given* pairs as a JVM expression: ``points`` already carries the ``query_id`` it belongs to.

    For re-scoring a short candidate list; a search over the whole table is ``dense_search``.
    """
    joined = points.join(queries.select("query_id", "vector"), "query_id")
    return joined.withColumn("score", pair_score(metric, F.col("vector"), F.col(using)))


# --- sparse ---------------------------------------------------------------------------------------------


def term_statistics(points: DataFrame, terms: DataFrame | None = None, using: str = "sparse") -> DataFrame:
    """``(index, df, n)``: in how many points an index occurs, and how many points have a sparse vector.

    An index is counted before it is shuffled, so a term of every text costs one row per task.  The
    counts are written once (they are the size of the vocabulary) because they are read twice.
    """
    # The extra index -1 marks every vector once, so one pass gives both numbers.
    marks = bind(F.col(f"{using}.indices"), lambda i: F.when(F.size(i) > 0, F.concat(F.array(F.lit(-1)), i)))
    marked = points.select(F.explode(marks).alias("index"))
    if terms is None:
        counts = marked.groupBy("index").agg(F.count("*").alias("df"))
    else:
        always = points.sparkSession.range(1).select(F.lit(-1).alias("index"))
        wanted = written(terms.select(F.col("index").cast("int")).unionByName(always), "wanted")
        if wanted.count() <= BROADCAST_TERMS:
            marked = marked.join(F.broadcast(wanted), "index", "left_semi")
            counts = marked.groupBy("index").agg(F.count("*").alias("df"))
        else:
            # Too many to send around: count everything where it lies, then pick.
            counts = marked.groupBy("index").agg(F.count("*").alias("df")).join(wanted, "index", "left_semi")
    counts = written(counts, "terms")
    total = counts.filter("index = -1").head()
    return counts.filter("index >= 0").withColumn("n", F.lit(total["df"] if total else 0).cast("bigint"))


def inverse_frequency(df: Column, n: Column) -> Column:
    """Robertson's IDF, never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weigh_by_frequency(queries: DataFrame, statistics: DataFrame) -> DataFrame:
    """Multiply query weights by the IDF of their index; indices no point has are dropped."""
    exploded = queries.select(
        "query_id", F.explode(F.arrays_zip(F.col("sparse.indices").alias("index"), F.col("sparse.values").alias("value")))
        .alias("t")
    ).select("query_id", F.col("t.index").alias("index"), F.col("t.value").alias("value"))
    weighted = exploded.join(statistics, "index").select(
        "query_id",
        F.struct(
            F.col("index"),
            F.round(F.col("value") * inverse_frequency(F.col("df"), F.col("n")), 6).alias("value"),
        ).alias("t"),
    )
    # One query's terms: as many as its text has distinct tokens.
    gathered = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select(
        "query_id", F.struct(F.col("t.index").alias("indices"), F.col("t.value").alias("values")).alias("sparse")
    )


def sparse_search(
    queries: DataFrame,
    points: DataFrame,
    k: int = DEFAULT_LIMIT,
    *,
    filter: Mapping | None = None,
    idf: bool = False,
    statistics: DataFrame | None = None,
    using: str = "sparse",
    broadcast_numbers: int = BROADCAST_NUMBERS,
) -> DataFrame:
    """Top ``k`` by the sum of products over shared indices; no shared index, no hit.

    ``queries`` has ``query_id`` and ``sparse``.  With ``idf`` the query weights are scaled by
    ``statistics`` (see ``term_statistics``), or by statistics counted here over all points.
    """
    check_limit(k)
    # Empty vectors score nothing by themselves.  A filter on them would be pushed below the expression that
    # makes them and compute it twice.
    wanted = queries.select("query_id", "sparse")
    if idf:
        if statistics is None:
            terms = wanted.select(F.explode("sparse.indices").alias("index")).distinct()
            statistics = term_statistics(points, terms, using)
        wanted = weigh_by_frequency(wanted, statistics)
    wanted = wanted.select(
        "query_id", F.col("sparse.indices").alias("indices"), F.col("sparse.values").cast("array<double>").alias("values")
    )
    rows = apply_filter(points, filter).select(
        F.col("id").cast("string").alias("id"), F.col(using).getField("indices").alias("indices"),
        F.col(using).getField("values").cast("array<double>").alias("values"),
    )
    return _top_k(wanted, rows, k, F.coalesce(F.size("indices"), F.lit(0)), SparseBlock, True, broadcast_numbers)


# --- placement of the work ------------------------------------------------------------------------------


def _top_k(queries, rows, k, width: Column, make_block, larger_is_better, broadcast_numbers) -> DataFrame:
    query_type = to_arrow_type(queries.schema["query_id"].dataType)

    def answer(query_table: pa.Table, batches) -> pa.Table:
        return best_of(make_block(query_table), batches, k, larger_is_better, query_type)

    out = [T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())]
    candidates = block_scan(queries, rows, width, answer, out, broadcast_numbers)
    return ranked(candidates, k, larger_is_better)


def block_scan(
    queries: DataFrame, rows: DataFrame, width: Column, answer, out: list[T.StructField], broadcast_numbers: int = BROADCAST_NUMBERS
) -> DataFrame:
    """Show every point to every query, in blocks: ``answer(query table, point batches)`` gives the rows ``(query_id, *out)``.

    ``width`` is how many stored numbers a row of either side holds.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *out])
    ship_package(spark)
    # Kept while it is measured and read; the grid path reads it again later and leaves it to the cache.
    queries = queries.persist()
    numbers = queries.agg(F.sum(F.greatest(width, F.lit(QUERY_NUMBERS)).cast("bigint")).alias("n")).head()["n"] or 0
    if numbers > broadcast_numbers:
        return _grid(queries, rows, width, numbers, answer, schema, broadcast_numbers)
    # The size was just measured, so this table is small; it goes to every executor once and the points
    # are neither shuffled nor repeated.
    shared = spark.sparkContext.broadcast(queries.toArrow().combine_chunks())
    queries.unpersist()

    def scan(batches):
        yield from answer(shared.value, batches).to_batches()

    return rows.mapInArrow(scan, schema)


def _grid(queries, rows, width, numbers, answer, schema, block_numbers) -> DataFrame:
    """Any number of queries: every (query slice, point slice) cell is one bounded task.

    Slices are cut by hash of the ids, so they are even however the values are distributed.  Points are
    repeated once per query slice and queries once per point slice; both slice counts follow from
    measured sizes.
    """
    held = rows.agg(F.sum(width.cast("bigint")).alias("n")).head()["n"] or 0
    q_slices = max(1, -(-numbers // max(1, block_numbers)))
    p_slices = max(1, -(-held // CELL_NUMBERS), min(rows.sparkSession.sparkContext.defaultParallelism, 1 + held // 100_000))

    def slice_of(column, n):
        return F.pmod(F.xxhash64(column), F.lit(n))

    left = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(p_slices - 1))).alias("_p"), slice_of("query_id", q_slices).alias("_q"), "*"
    )
    right = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(q_slices - 1))).alias("_q"), slice_of("id", p_slices).alias("_p"), "*"
    )
    cell = (F.col("_p") * F.lit(q_slices) + F.col("_q")).cast("bigint").alias("_cell")
    left = left.select(cell, *queries.columns)
    right = right.select(cell, *rows.columns)

    def score_cell(query_table: pa.Table, point_table: pa.Table) -> pa.Table:
        return answer(query_table, point_table.to_batches())

    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(score_cell, schema)


def ranked(candidates: DataFrame, k: int, larger_is_better: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best ``k`` candidates per query with their rank; ``keep`` names further columns.

    With many point tasks a query has (tasks x k) candidates; they are first cut to k within each of
    several groups so that no single task has to sort them all.
    """
    by = [F.col("score").desc() if larger_is_better else F.col("score").asc(), F.col("id").asc()]
    groups = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64
    if groups > 1:
        salted = candidates.withColumn("_group", F.pmod(F.xxhash64("id"), F.lit(groups)))
        first = F.row_number().over(W.partitionBy("query_id", "_group").orderBy(*by))
        candidates = salted.withColumn("_r", first).filter(F.col("_r") <= k).drop("_r", "_group")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*by))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", "score", *keep
    )


# --- hybrid ---------------------------------------------------------------------------------------------


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    share = F.lit(1.0) / (F.col("rank") + F.lit(rrf_k))
    lists = dense_hits.select("query_id", "id", share.alias("s")).unionByName(
        sparse_hits.select("query_id", "id", share.alias("s"))
    )
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    return ranked(fused, k)


def hybrid_search(
    queries: DataFrame,
    points: DataFrame,
    k: int = DEFAULT_LIMIT,
    *,
    filter: Mapping | None = None,
    filter_stage: str = "pre",
    metric: str = "cosine",
    idf: bool = False,
    statistics: DataFrame | None = None,
    rrf_k: int = RRF_K,
    dense_using: str = "dense",
    sparse_using: str = "sparse",
    vector_size: int | None = None,
) -> DataFrame:
    """Dense top ``k`` and sparse top ``k``, fused by rank.

    ``filter_stage="pre"`` filters what both branches see; ``"post"`` filters the fused hits.
    """
    if filter_stage not in ("pre", "post"):
        raise ValueError("'filter_stage' must be 'pre' or 'post'")
    pre = filter if filter_stage == "pre" else None
    dense = dense_search(queries, points, k, filter=pre, metric=metric, using=dense_using, vector_size=vector_size)
    sparse = sparse_search(queries, points, k, filter=pre, idf=idf, statistics=statistics, using=sparse_using)
    if filter_stage == "pre" or not filter:
        return fuse(dense, sparse, k, rrf_k)
    # Ids are unique, so an inner join filters; the written hits have a known size and are broadcast if small.
    hits = written(fuse(dense, sparse, min(2 * k, 2 * MAX_LIMIT), rrf_k).drop("rank"), "hits")
    passing = apply_filter(points, filter).select(F.col("id").cast("string").alias("id"))
    return ranked(hits.join(passing, "id").select("query_id", "id", "score"), k)


# --- requests -------------------------------------------------------------------------------------------


def resolve_mode(requests: DataFrame) -> DataFrame:
    """Add ``mode``.  Uses ``search_mode``, ``default_mode`` (logical collections only), ``has_sparse``, ``has_terms``, ``has_dense``.

    An explicit mode wins; ``auto`` takes the logical default, else hybrid where the collection has a
    sparse vector, else dense.  Hybrid without a sparse query is dense; hybrid without a dense query is sparse; sparse without
    a sparse query is dense, and can only be answered if a vector was given (see ``mode_rules``).
    """
    asked = F.lower(F.coalesce("search_mode", F.lit("auto")))
    first = (
        F.when(asked != "auto", asked)
        .when(F.col("default_mode").isNotNull(), F.col("default_mode"))
        .when(F.col("has_sparse"), F.lit("hybrid"))
        .otherwise(F.lit("dense"))
    )
    no_terms = ~(F.coalesce("has_sparse", F.lit(False)) & F.coalesce("has_terms", F.lit(False)))
    return requests.withColumn("mode", first).withColumn(
        "mode",
        F.when(F.col("mode").isin("hybrid", "sparse") & no_terms, F.lit("dense"))
        .when((F.col("mode") == "hybrid") & ~F.col("has_dense"), F.lit("sparse"))
        .otherwise(F.col("mode")),
    )


def mode_rules() -> list[tuple[Column, Column]]:
    """A resolved request that has to be dense needs a vector."""
    reason = F.concat(
        F.lit("Collection '"), F.col("collection"), F.lit("' requires a dense vector for query mode '"),
        F.lower(F.coalesce("search_mode", F.lit("auto"))), F.lit("'"),
    )
    return [((F.col("mode") == "dense") & ~F.col("has_dense"), reason)]


def text_queries(requests: DataFrame) -> DataFrame:
    """``dense_text`` and ``sparse``: the embedding uses ``text``, the terms use ``query_text``, each falls
    back to the other."""
    terms_of = F.coalesce("query_text", "text")
    return requests.withColumn("dense_text", F.coalesce("text", "query_text")).withColumn(
        "sparse", F.when(~is_blank(terms_of), sparse_or_null(terms_of))
    )


def search_requests(
    requests: DataFrame,
    points: DataFrame,
    *,
    filter: Mapping | None = None,
    metric: str = "cosine",
    idf: bool = False,
    statistics: DataFrame | None = None,
    rrf_k: int = RRF_K,
) -> DataFrame:
    """Answer requests of mixed modes and limits with one dense and one sparse scan.

    ``requests``: ``query_id, mode, limit, vector, sparse`` (see ``resolve_mode`` and ``text_queries``).
    A branch of a hybrid request is cut to the request's own limit before fusion.  A null limit is ``DEFAULT_LIMIT``;
    the largest limit of the table decides how deep the scans go, and one above ``MAX_LIMIT`` is an error.
    """
    own = F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).cast("bigint")
    max_limit = requests.agg(F.max(own)).first()[0] or DEFAULT_LIMIT
    check_limit(max_limit)
    limits = requests.select("query_id", "mode", own.alias("limit"))
    dense = dense_search(
        requests.filter(F.col("mode").isin("dense", "hybrid")), points, max_limit, filter=filter, metric=metric
    )
    sparse = sparse_search(
        requests.filter(F.col("mode").isin("sparse", "hybrid")), points, max_limit,
        filter=filter, idf=idf, statistics=statistics,
    )
    hits = dense.unionByName(sparse).join(limits, "query_id").filter(F.col("rank") <= F.col("limit"))
    return merge_branches(hits, rrf_k)


def merge_branches(hits: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """The answer of each request from the ranked hits of its branches: ``query_id, mode, limit, rank, id, score``.

    Two branches are fused by rank; the one branch of a dense or sparse request keeps its scores and its order.
    """
    hybrid = F.col("mode") == "hybrid"
    merged = hits.groupBy("query_id", "mode", "limit", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.col("rank") + F.lit(rrf_k))), 9).alias("_fused"),
        # A request of one branch has one row per id.
        F.max("score").alias("_score"), F.min("rank").alias("_rank"),
    )
    by = [F.when(hybrid, -F.col("_fused")).otherwise(F.col("_rank").cast("double")), F.col("id")]
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*by)).cast("bigint")
    return (
        merged.withColumn("rank", place)
        .filter(F.col("rank") <= F.col("limit"))
        .select("query_id", "mode", "rank", "id", F.when(hybrid, F.col("_fused")).otherwise(F.col("_score")).alias("score"))
    )


def attach_points(hits: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Result projection: add payload or vector columns to the hits.

    The wide columns never travel through the top-k.  The hits are written first: with their size known, a
    small set of ids is broadcast and cuts the points down in the scan's own task, so the wide rows of other
    points are not shuffled.
    """
    hits = written(hits, "hits")
    wide = points.select(F.col("id").cast("string").alias("id"), *columns)
    found = wide.join(hits.select("id").distinct(), "id", "left_semi")
    return hits.join(found, "id", "left").select(*hits.columns, *columns)
