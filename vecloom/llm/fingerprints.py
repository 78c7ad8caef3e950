"""Document fingerprints: SimHash over word shingles, and a search by permuted block tables.

Every shingle's 64-bit hash votes on each bit, with the shingle's number of occurrences as its weight; a bit is set if
more than half of the weight votes for it.  Votes are added in lanes of 64-bit numbers, several bits at once, so that a
text needs a few sums over its hashes and no row for each shingle.  All of it is Spark expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 3
RADIUS = 3
# More blocks than the radius: tables are keyed by the blocks that are left when the differing ones are taken away.
BLOCKS = 5
ROWS_IN_RANGE = 4_000
MOST_RANGES = 4_096


def _hashes(text: Column) -> tuple[Column, Column]:
    """The words, and from the column ``_words`` the hashes of all shingles of words; of the whole text if it has fewer words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size("_words")
    parts = F.arrays_zip(*[F.slice("_words", k + 1, F.greatest(n - (SHINGLE - 1), F.lit(0))).alias(f"w{k}") for k in range(SHINGLE)])
    shingles = F.transform(parts, lambda p: F.xxhash64(*[p[f"w{k}"] for k in range(SHINGLE)]))
    return words, F.when(n >= SHINGLE, shingles).when(n > 0, F.array(F.xxhash64(F.array_join("_words", " ")))).otherwise(F.array().cast("array<bigint>"))


def _votes(hashes: str, lane: int) -> list[Column]:
    """For each k below ``lane``: the sum over all hashes of bits k, k + lane, k + 2 lane ... in lanes of that width."""
    mask = sum(1 << at for at in range(0, 64, lane))

    def add(k: int):
        return lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask))

    return [F.aggregate(hashes, F.lit(0).cast("long"), add(k)) for k in range(lane)]


def _bits(sums: str, count: Column, lane: int) -> Column:
    """The 64 bits that more than half of the votes set, as a number."""
    ones = (1 << lane) - 1
    result = F.lit(0).cast("long")
    for bit in range(64):
        votes = F.shiftrightunsigned(F.col(sums)[bit % lane], bit - bit % lane).bitwiseAND(F.lit(ones))
        value = (1 << bit) - (1 << 64 if bit == 63 else 0)
        result = result.bitwiseOR(F.when(votes * 2 > count, F.lit(value)).otherwise(F.lit(0).cast("long")))
    return result


def simhash(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the 64-bit fingerprint ``name`` of the column ``text``; without words it is 0.

    Lanes are 16 bits wide, and 32 for texts of so many shingles that 16 could run over.
    """
    words, hashes = _hashes(F.lower(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_words", words).withColumn("_hashes", hashes).drop("_words")
    n = F.size("_hashes")
    df = df.withColumn("_narrow", F.when(n < 65_536, F.array(*_votes("_hashes", 16)))).withColumn("_wide", F.when(n >= 65_536, F.array(*_votes("_hashes", 32))))
    df = df.withColumn("_count", n.cast("long")).drop("_hashes")
    bits = F.when(F.col("_narrow").isNotNull(), _bits("_narrow", F.col("_count"), 16)).otherwise(_bits("_wide", F.col("_count"), 32))
    return df.withColumn(name, bits).drop("_narrow", "_wide", "_count")


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def with_next(docs: DataFrame, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``: the text of the next row by descending doc_id; after the last, the first.

    Null ids come last; equal ids are ordered by text.  Rows are dealt to ranges of ids whose borders are ids of the table; a
    border row also goes to the range before it as a guest, so no range has to look into another.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = min(max(-(-n // rows_in_range), 1), MOST_RANGES)
    share = [k / ranges for k in range(1, ranges)]
    picked = docs.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", share or [0.5], 10 * MOST_RANGES).alias("cuts")).first()
    # Descending; every border is the first id of its range.
    borders = sorted({x for x in [picked["top"], *((picked["cuts"] or []) if share else [])] if x is not None}, reverse=True)
    known = F.array(*map(F.lit, borders)) if borders else F.array().cast("array<bigint>")
    own = F.when(F.col("doc_id").isNull(), F.lit(max(len(borders) - 1, 0))).otherwise(F.size(F.filter(known, lambda b: b >= F.col("doc_id"))) - 1)
    last = max(len(borders) - 1, 0)
    first_id = F.lit(borders[0] if borders else None).cast("long")
    place = F.struct(F.col("_own").alias("range"), F.lit(0).alias("guest"))
    as_guest = F.struct(F.when(F.col("doc_id").eqNullSafe(first_id), F.lit(last)).otherwise(F.col("_own") - 1).alias("range"), F.lit(1).alias("guest"))
    is_border = F.array_contains(known, F.col("doc_id")) if borders else F.col("doc_id").isNull()
    placed = docs.withColumn("_own", own).withColumn("_at", F.explode(F.when(F.coalesce(is_border, F.lit(False)), F.array(place, as_guest)).otherwise(F.array(place))))
    # A guest of the next range comes after all rows of the range.
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = placed.select("doc_id", "text", F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest"))
    return rows.withColumn("next_text", F.lead("text").over(order)).where("_guest = 0").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The text whose last third is replaced by the first characters of another, as many or all."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each row: fingerprints of its text, of its edited text and of the next text (64-bit numbers), sizes and digest.

    A null text is empty.  Every row gets its own result, repeated ones and those without an id too.
    """
    rows = with_next(docs.select("doc_id", "text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = simhash(rows, "text", "own").withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    return simhash(simhash(rows.drop("text"), "edited", "changed").drop("edited"), "next_text", "following").drop("next_text")


def near_fingerprints(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found): all pairs of different 64-bit numbers ``fp`` of the two tables within the Hamming radius.

    Equal numbers are one.  Two numbers within the radius agree in at least ``blocks - radius`` blocks, so each table keyed by
    so many blocks is searched; a pair is found once, in the first table where it agrees.
    """
    width, extra = divmod(64, blocks)
    spans, at = [], 0
    for k in range(blocks):
        spans.append((at, width + (k < extra)))
        at += spans[-1][1]

    def key(held: tuple[int, ...]) -> Column:
        mask = sum(((1 << size) - 1) << low for low, size in (spans[k] for k in held))
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    tables = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), key(held).alias("key")) for t, held in enumerate(tables)])
        return df.select(F.col("fp")).where("fp is not null").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("k")).select(name, "k.*")

    met = keyed(queries, "query").join(keyed(fingerprints, "found"), ["t", "key"])
    differ = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    return met.where((differ <= radius) & (differ > 0)).select("query", "found").distinct()
