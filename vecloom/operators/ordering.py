"""Ordered work over groups of any size.

A window over ``partitionBy(key)`` puts a whole key in one task, which fails when one key holds a third
of the table.  Here the rows are range-partitioned on key *and* order, so a large key is cut into many
chunks; what crosses a chunk border is one summary row per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.session import written

POSITION = "_position"
CHUNK = "_chunk"


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Range-partition and sort on ``keys`` + ``order``, then number the rows.

    ``order`` must end in something unique, or equal rows cannot be cut apart.  The split is
    written down: both uses below must see the same chunks, and a re-run of a lost task must too.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(POSITION, F.monotonically_increasing_id())
    return written(placed.withColumn(CHUNK, F.shiftright(POSITION, 33)), "chunks")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "row_number") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without a window over the rows."""
    chunks = ordered_chunks(df, keys, order)
    parts = chunks.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n"), F.min(POSITION).alias("_first"))
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, CHUNK, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return _with_summary(chunks, offsets, keys).select(
        *df.columns, (F.col(POSITION) + F.col("_shift")).cast("bigint").alias(name)
    )


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence, columns: Sequence[str]) -> DataFrame:
    """Replace nulls in ``columns`` by the last earlier non-null value of the same key."""
    chunks = ordered_chunks(df, keys, order)
    so_far = W.partitionBy(*keys, CHUNK).orderBy(POSITION).rowsBetween(W.unboundedPreceding, 0)
    local = chunks.select(
        *keys, CHUNK, *[c for c in df.columns if c not in keys and c not in columns],
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in columns],
    )
    ends = chunks.groupBy(*keys, CHUNK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(POSITION))).alias(c) for c in columns]
    )
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys, CHUNK, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns]
    )
    filled = {c: F.coalesce(F.col(c), F.col(f"_in_{c}")).alias(c) for c in columns}
    return _with_summary(local, carried, keys).select(*[filled.get(c, F.col(c)) for c in df.columns])


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence, column: str, name: str) -> DataFrame:
    """Add ``name``: the largest ``column`` of the earlier rows of the same key; null for the first, and while all are null."""
    chunks = ordered_chunks(df, keys, order)
    before = W.partitionBy(*keys, CHUNK).orderBy(POSITION).rowsBetween(W.unboundedPreceding, -1)
    local = chunks.withColumn("_local", F.max(column).over(before))
    ends = chunks.groupBy(*keys, CHUNK).agg(F.max(column).alias("_max"))
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, CHUNK, F.max("_max").over(earlier).alias("_carried"))
    return _with_summary(local, carried, keys).select(*df.columns, F.greatest("_local", "_carried").alias(name))


def _with_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows to their (key, chunk) summary; keys may be null, so compare null-safe."""
    renamed = summary.select(
        *[F.col(k).alias(f"_s_{k}") for k in (*keys, CHUNK)],
        *[c for c in summary.columns if c not in keys and c != CHUNK],
    )
    on = F.col(CHUNK) == F.col(f"_s_{CHUNK}")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_s_{key}"))
    return rows.join(renamed, on, "inner")


def newest(df: DataFrame, keys: Sequence[str], order, n: int = 1) -> DataFrame:
    """The ``n`` rows of each key that come first in ``order``.

    Spark cuts each map task to ``n`` rows per key before the shuffle (WindowGroupLimit), so a large key
    moves at most ``n`` rows per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(order if isinstance(order, (list, tuple)) else [order])))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
