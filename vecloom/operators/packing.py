"""Batches of requests that bring several texts each: a request joins the batch before it if it still fits.

The rule is greedy, so a batch's end depends on all before it.  It is worked out in three passes over range chunks of a key, without
walking through the batches one after the other.  In a chunk the request that begins the next batch is found for every
request from running sums; following these successors by doubling tells, for every number of texts the open batch may bring
into the chunk, how many it brings out.  These small tables are chained over the chunks by doubling again, which gives the state each chunk
really starts with, and with it the batch of every request.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators.ordering import CHUNK, POSITION, ordered_chunks
from vecloom.session import ship_package, written


def successors(sizes: np.ndarray, limit: int) -> np.ndarray:
    """For each request the one that begins the next batch if a batch begins with it (``len(sizes)``: none here)."""
    ends = np.cumsum(sizes)
    before = ends - sizes
    too_many = np.searchsorted(ends, before + limit, side="right")
    full = np.searchsorted(before, before + limit, side="left")
    return np.maximum(np.minimum(too_many, full), np.arange(1, len(sizes) + 1))


def first_break(sizes: np.ndarray, held: np.ndarray, limit: int) -> np.ndarray:
    """The first request that does not fit into a batch that brings ``held`` texts."""
    ends = np.cumsum(sizes)
    return np.minimum(np.searchsorted(ends, limit - held, side="right"), np.searchsorted(ends - sizes, limit - held, side="left"))


def transfer(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of texts from 0 to ``limit`` that come in: the number that goes out, and how many batches begin here.

    A batch of ``limit`` texts or more counts as one of ``limit``, and so does nothing at all: whatever comes begins a batch.
    """
    m, total = len(sizes), int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    # Each request's way to the last batch of the chunk: where it has come to, and the batches begun on it.  ``m`` is the chunk's end.
    jump = np.append(successors(sizes, limit), m)
    last, begun = np.arange(m + 1), np.ones(m + 1, np.int64)
    leap, length = jump.copy(), np.ones(m + 1, np.int64)
    leaps = []
    while (leap < m).any():
        leaps.append((leap, length))
        length = np.where(leap < m, length + length[leap], length)
        leap = leap[leap]
    for leap, length in reversed(leaps):
        # The longest leap that stays inside is taken first.
        inside = leap[last] < m
        begun = np.where(inside, begun + length[last], begun)
        last = np.where(inside, leap[last], last)
    held = np.arange(limit + 1)
    at = first_break(sizes, held, limit)
    stays = at >= m
    at = np.minimum(at, m - 1)
    out = np.where(stays, held + total, total - before[last[at]])
    return np.minimum(out, limit), np.where(stays, 0, begun[at])


def packed_batches(
    requests: DataFrame, key: Sequence[str], arrival: Sequence, size: str, max_batch: int | Column, name: str = "batch_no"
) -> DataFrame:
    """Number the batches of each ``key`` from 0: requests of ``size`` texts in order of ``arrival``, at most ``max_batch`` texts each.

    A request of more texts than that is a batch of its own; one without texts joins any batch that is not full.  ``max_batch`` is the same
    for all requests of a key; ``arrival`` must end in something unique.  A null size counts as none.
    """
    ship_package(requests.sparkSession)
    limit = F.lit(max_batch) if isinstance(max_batch, int) else max_batch
    sized = requests.withColumns({"_size": F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0)), "_limit": limit.cast("bigint")})
    chunks = ordered_chunks(sized, key, arrival)
    slim = chunks.select(*key, CHUNK, POSITION, "_size", "_limit")
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    head = ", ".join(f"`{c}` {types[c]}" for c in (*key, CHUNK))

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(POSITION)
        out, begun = transfer(rows["_size"].to_numpy(), int(rows["_limit"].iloc[0]))
        first = {c: [rows[c].iloc[0]] * len(out) for c in (*key, CHUNK)}
        return pd.DataFrame(first | {"held": np.arange(len(out)), "goes_out": out, "begun": begun, "top": len(out) - 1})

    ways = slim.groupBy(*key, CHUNK).applyInPandas(table, f"{head}, held bigint, goes_out bigint, begun bigint, top bigint")
    states = _entries(written(ways, "ways"), key)
    joined = _beside(slim, states, key)

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(POSITION)
        sizes, top = rows["_size"].to_numpy(), int(rows["_limit"].iloc[0])
        held, begun = int(rows["_held"].iloc[0]), int(rows["_begun"].iloc[0])
        m = len(sizes)
        jump = np.append(successors(sizes, top), m)
        starts = np.zeros(m + 1, bool)
        starts[first_break(sizes, np.array([held]), top)[0]] = True
        while True:
            reached = starts.copy()
            reached[jump[starts]] = True
            if (reached == starts).all():
                break
            starts, jump = reached, jump[jump]
        return pd.DataFrame({POSITION: rows[POSITION], "_number": begun + np.cumsum(starts[:m]) - 1})

    numbers = joined.groupBy(*key, CHUNK).applyInPandas(number, f"{POSITION} bigint, _number bigint")
    # Positions are unique over all chunks.
    found = chunks.join(numbers.withColumnRenamed(POSITION, "_at"), F.col(POSITION) == F.col("_at"))
    return found.select(*requests.columns, F.col("_number").alias(name))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def _beside(rows: DataFrame, states: DataFrame, key: Sequence[str]) -> DataFrame:
    other = states.select(*[F.col(c).alias(f"_s_{c}") for c in (*key, CHUNK)], F.col("held").alias("_held"), F.col("so_far").alias("_begun"))
    return rows.join(other, (F.col(CHUNK) == F.col(f"_s_{CHUNK}")) & _same(key, [f"_s_{c}" for c in key])).drop(*[f"_s_{c}" for c in (*key, CHUNK)])


def _entries(ways: DataFrame, key: Sequence[str]) -> DataFrame:
    """The state each chunk of a key starts with: ``held`` texts, ``so_far`` batches begun before.

    ``ways`` are links from (chunk, held) to the next chunk.  Marked states start as the first chunk of each key with nothing open; in each
    round they spread along links of double length, so the rounds are the logarithm of the chunks of the busiest key.
    """
    order = W.partitionBy(*key).orderBy(CHUNK)
    places = ways.select(*key, CHUNK).distinct().withColumn("seq", F.row_number().over(order))
    renamed = places.select(*[F.col(c).alias(f"_p_{c}") for c in (*key, CHUNK)], "seq")
    placed = ways.join(renamed, (F.col(CHUNK) == F.col(f"_p_{CHUNK}")) & _same(key, [f"_p_{c}" for c in key]))
    placed = written(placed.select(*key, CHUNK, "seq", "held", "goes_out", "begun", "top"), "placed")
    rounds = int(placed.agg(F.max("seq")).head()[0] or 1)
    jump = placed.select(*key, "seq", "held", (F.col("seq") + 1).alias("to_seq"), F.col("goes_out").alias("to_held"), "begun")
    marked = placed.filter("seq = 1 and held = top").select(*key, "seq", "held", F.lit(0).cast("bigint").alias("so_far"))
    length = 1
    while length < rounds:
        # Links of this length, seen from where they begin.
        link = jump.select(*[F.col(c).alias(f"_l_{c}") for c in key], F.col("seq").alias("_seq"), F.col("held").alias("_held"), "to_seq", "to_held", "begun")
        on = (F.col("seq") == F.col("_seq")) & (F.col("held") == F.col("_held")) & _same(key, [f"_l_{c}" for c in key])
        ahead = marked.join(link, on).select(*key, F.col("to_seq").alias("seq"), F.col("to_held").alias("held"), (F.col("so_far") + F.col("begun")).alias("so_far"))
        marked = written(marked.unionByName(ahead), "marked")
        first = jump.select(*key, "seq", "held", F.col("to_seq").alias("mid_seq"), F.col("to_held").alias("mid_held"), F.col("begun").alias("first_begun"))
        on = (F.col("mid_seq") == F.col("_seq")) & (F.col("mid_held") == F.col("_held")) & _same(key, [f"_l_{c}" for c in key])
        twice = first.join(link, on).select(*key, "seq", "held", "to_seq", "to_held", (F.col("first_begun") + F.col("begun")).alias("begun"))
        length *= 2
        jump = written(twice, "links") if length < rounds else twice
    marked = marked.select(*[F.col(c).alias(f"_m_{c}") for c in key], F.col("seq").alias("_seq"), F.col("held").alias("_held"), "so_far")
    on = (F.col("seq") == F.col("_seq")) & (F.col("held") == F.col("_held")) & _same(key, [f"_m_{c}" for c in key])
    return placed.join(marked, on).select(*key, CHUNK, "held", "so_far")
