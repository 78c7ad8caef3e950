"""Compare two large tables by digests: rows are looked at only where the digests of their ranges differ.

Both sides are cut by a hash of the key into ranges, and these into smaller ones.  The digest of a range is the number of its rows
and two combinations of their hashes that do not depend on order.  A first pass over each side gives the digests of the ranges, a second one
those of the parts of ranges that differ, and only the rows of differing parts are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import written

RANGES = 4096
PARTS = 64


@dataclass(frozen=True)
class Comparison:
    """``report``: one row per partition; ``differences``: the rows that differ with both values; ``looked_at``: differing ranges and parts."""

    report: DataFrame
    differences: DataFrame
    looked_at: tuple[int, int]


def _flagged(columns: Sequence[str]) -> list[Column]:
    # A hash skips nulls, so each column goes in with a flag: a value that moved to another column differs.
    return [part for c in columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]


def _placed(df: DataFrame, key: str, ranges: int, parts: int) -> DataFrame:
    place = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(17)), F.lit(ranges * parts))
    return df.withColumn("_range", F.floor(place / parts).cast("int")).withColumn("_part", (place % parts).cast("int"))


def digests(placed: DataFrame, by: Sequence[str], partition_key: str, columns: Sequence[str], key: str) -> DataFrame:
    """``by, _p, n, total, mixed`` for every range and partition value; combined on the map side."""
    row = F.xxhash64(F.col(f"`{key}`"), *_flagged([*columns, partition_key]))
    hashed = placed.select(*by, F.col(f"`{partition_key}`").alias("_p"), row.alias("_h"))
    return hashed.groupBy(*by, "_p").agg(
        F.count("*").alias("n"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("total"), F.bit_xor("_h").alias("mixed")
    )


def _differing(source: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ranges in which any partition value has another digest, or is on one side only."""
    both = source.withColumn("_side", F.lit(1)).unionByName(target.withColumn("_side", F.lit(-1)))
    # Equal digests cancel out.
    kept = both.groupBy(*by, "_p", "n", "total", "mixed").agg(F.sum("_side").alias("_left")).filter("_left <> 0")
    return written(kept.select(*by).distinct(), "differing")


def compare_tables(
    source: DataFrame, target: DataFrame, partition_key: str, columns: Sequence[str], key: str = "id", *, ranges: int = RANGES, parts: int = PARTS
) -> Comparison:
    """What a backfill left behind.  ``report`` has the columns of ``verify_backfill``, for keys that are unique on each side.

    ``differences``: ``key, partition, kind`` (missing, extra, differing) and the compared columns of both sides as ``source`` and ``target``.  Rows that
    moved to another partition value count as differing, under that of the source unless it is null.
    """
    ours, theirs = _placed(source, key, ranges, parts), _placed(target, key, ranges, parts)
    coarse = [written(digests(df, ["_range"], partition_key, columns, key), "digests") for df in (ours, theirs)]
    # At most ``ranges`` rows, and ``ranges`` times ``parts`` below.
    wide = _differing(*coarse, ["_range"])
    n_ranges = wide.count()
    same = [coarse[0].join(F.broadcast(wide), "_range", "left_anti").select("_p", "n")]
    if n_ranges == 0:
        report = _report(same[0].select(F.col("_p"), F.col("n").alias("s"), F.col("n").alias("t"), *_zeros()), partition_key)
        return Comparison(report, _rows(ours.limit(0), theirs.limit(0), partition_key, columns, key), (0, 0))
    inside = [df.join(F.broadcast(wide), "_range", "left_semi") for df in (ours, theirs)]
    by = ["_range", "_part"]
    fine = [written(digests(df, by, partition_key, columns, key), "digests") for df in inside]
    narrow = _differing(*fine, by)
    same.append(fine[0].join(narrow, by, "left_anti").select("_p", "n"))
    touched = [df.join(narrow, by, "left_semi") for df in inside]
    agreed = same[0].unionByName(same[1]).select("_p", F.col("n").alias("s"), F.col("n").alias("t"), *_zeros())
    both = _slim(touched[0], partition_key, columns, key, "s").join(_slim(touched[1], partition_key, columns, key, "t"), "_key", "full_outer")
    in_s, in_t = F.col("_in_s").isNotNull(), F.col("_in_t").isNotNull()
    counted = both.select(
        F.coalesce("_p_s", "_p_t").alias("_p"), in_s.cast("bigint").alias("s"), in_t.cast("bigint").alias("t"),
        (in_s & ~in_t).cast("bigint").alias("missing"), (in_t & ~in_s).cast("bigint").alias("extra"),
        F.coalesce(F.col("_h_s") != F.col("_h_t"), F.lit(False)).cast("bigint").alias("differing"),
    )
    report = _report(agreed.unionByName(counted), partition_key)
    return Comparison(report, _rows(*touched, partition_key, columns, key), (n_ranges, narrow.count()))


def _zeros() -> list[Column]:
    return [F.lit(0).cast("bigint").alias(c) for c in ("missing", "extra", "differing")]


def _report(counts: DataFrame, partition_key: str) -> DataFrame:
    sums = counts.groupBy(F.col("_p").alias(partition_key)).agg(
        F.sum("s").alias("source_count"), F.sum("t").alias("target_count"), F.sum("missing").alias("missing"),
        F.sum("extra").alias("extra"), F.sum("differing").alias("differing"),
    )
    return sums.withColumn("result", F.when((F.col("missing") + F.col("extra") + F.col("differing")) == 0, "ok").otherwise("mismatch"))


def _slim(df: DataFrame, partition_key: str, columns: Sequence[str], key: str, side: str, *, values: bool = False) -> DataFrame:
    own = [F.col(f"`{key}`").alias("_key"), F.col(f"`{partition_key}`").alias(f"_p_{side}"), F.lit(1).alias(f"_in_{side}")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias(f"_v_{side}")
    return df.select(*own, F.xxhash64(*_flagged([*columns, partition_key])).alias(f"_h_{side}"), *([row] if values else []))


def _rows(ours: DataFrame, theirs: DataFrame, partition_key: str, columns: Sequence[str], key: str) -> DataFrame:
    both = _slim(ours, partition_key, columns, key, "s", values=True).join(_slim(theirs, partition_key, columns, key, "t", values=True), "_key", "full_outer")
    in_s, in_t = F.col("_in_s").isNotNull(), F.col("_in_t").isNotNull()
    kind = F.when(~in_t, "missing").when(~in_s, "extra").when(F.col("_h_s") != F.col("_h_t"), "differing")
    found = both.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    part = F.coalesce("_p_s", "_p_t")
    return found.select(F.col("_key").alias(key), part.alias("partition"), "kind", F.col("_v_s").alias("source"), F.col("_v_t").alias("target"))
