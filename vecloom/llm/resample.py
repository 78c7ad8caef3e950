"""Importance resampling towards a target: documents whose word runs look like the target's are drawn more often.

Features are all runs of 1 to ``n`` consecutive words, hashed into buckets.  A batch of texts is joined with a separator no
word can hold, one regular expression finds the words of the whole batch, and the words' positions among the texts' offsets
tell which runs would reach from one text into the next; what is left is counted by bucket.  Two passes over the texts: one
counts the buckets of the corpus, one scores each document by the gains they give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.base import slices, small_batches
from vecloom.operators.ordering import number_rows
from vecloom.session import written

# Bytes of a word: digits, small letters, and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SEPARATOR = b"\x00"
# Words looked at together; what a task holds besides its texts follows from it.
BLOCK = 1 << 16
# Longer words are hashed one by one.
LONG_WORD = 64
RESERVED = ("n_features", "weight", "score", "rank")


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> np.uint32(1)) ^ np.uint32(0xEDB88320), rows >> np.uint32(1))
    return rows


_CRC = _crc_table()
_START = np.uint32(0xFFFFFFFF)


def crc_over(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Carry CRC-32 registers on over one span of bytes each (``register`` is the inverted checksum)."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    long_ones = int(np.count_nonzero(sizes > LONG_WORD))
    state, at = register[order], starts[order]
    for i in range(long_ones):
        word = data[at[i] : at[i] + sizes[order[i]]].tobytes()
        state[i] = zlib.crc32(word, int(state[i] ^ _START)) ^ 0xFFFFFFFF
    state, rest = state.copy(), state[long_ones:]
    at, sizes = at[long_ones:], sizes[order[long_ones:]]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        held = rest[:live]
        rest[:live] = _CRC[(held ^ data[at[:live] + step]) & np.uint32(0xFF)] ^ (held >> np.uint32(8))
    state[long_ones:] = rest
    out = np.empty_like(state)
    out[order] = state
    return out


def _space(register: np.ndarray) -> np.ndarray:
    return _CRC[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8))


def buckets_of(texts: Sequence[bytes], n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``(document, bucket, length)`` of all word runs of a batch of texts.

    The last words of a block are carried into the next one, so runs across the border are there too.
    """
    joined = SEPARATOR.join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    found = WORD.finditer(joined)
    # For each shorter run length the register of the run that ends at the word before, and its document.
    carried = [np.zeros(0, np.uint32)] * (n - 1)
    carried_doc = np.zeros(0, np.int64)
    while True:
        spans = np.array([m.span() for m in islice(found, BLOCK)], np.int64).reshape(-1, 2)
        if not len(spans):
            return
        starts, ends = spans[:, 0], spans[:, 1]
        doc = np.searchsorted(begins, starts, side="right") - 1
        fresh = crc_over(np.full(len(doc), _START), data, starts, ends)
        yield doc, (fresh ^ _START) % np.uint32(buckets), np.ones(len(doc), np.int8)
        before, states = fresh, [fresh]
        all_docs = np.concatenate([carried_doc, doc])
        for length in range(2, n + 1):
            # ``before`` holds runs of one word less that end at each word of this block; shift them by one word.
            previous = np.concatenate([carried[length - 2], before])[: len(doc) + len(carried[length - 2]) - 1]
            missing = len(doc) - len(previous)
            previous = np.concatenate([np.zeros(missing, np.uint32), previous])
            # The run is whole if the word ``length - 1`` places back belongs to the same text.
            back = np.full(len(doc), -1, np.int64)
            seen = len(carried_doc)
            places = np.arange(len(doc)) + seen - (length - 1)
            back[places >= 0] = all_docs[places[places >= 0]]
            before = crc_over(_space(previous), data, starts, ends)
            inside = back == doc
            yield doc[inside], (before[inside] ^ _START) % np.uint32(buckets), np.full(int(inside.sum()), length, np.int8)
            states.append(before)
        carried = [state[-1:] for state in states[: n - 1]]
        carried_doc = all_docs[-(n - 1) :] if n > 1 else carried_doc


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [text or b"" for text in batch.column("text").cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, *, text: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket; a null text has none.

    A task adds up its texts and gives at most ``buckets`` rows, and as many come to the driver whatever the corpus.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, bucket, _ in buckets_of(_texts(part), n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null").mapInArrow(count, "bucket int, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for row in found:
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share in the target over that in the corpus, rounded down."""
    share = (target + 1.0) * (corpus.sum() + float(len(corpus))) / ((corpus + 1.0) * (target.sum() + float(len(corpus))))
    return np.floor(1000.0 * np.log(share)).astype(np.int64)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    key: str = "doc_id",
    n: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """``keep`` columns of every document with ``n_features, weight, score, rank`` (long).

    ``weight``: the mean gain of the document's features, 0 without any.  ``score`` adds noise that follows from ``seed`` and
    ``key`` alone (a null key is hashed as an empty one), so that the highest scores are a sample without replacement in
    proportion to the importance.  ``rank`` numbers the drawn documents, ``percent`` of those with ``least_words`` words or more; the
    rest have null.  Equal scores go by ``key`` (null first), then by ``n_features``; repeated rows are documents of their own.  Null and empty
    texts have no features.  Columns that are not kept are not read; a kept one must not be named like a new one.
    """
    clash = set(keep) & set(RESERVED)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be lost: rename them")
    if key not in keep:
        raise ValueError(f"'keep' must hold the key {key!r}")
    spark = docs.sparkSession
    gains = bucket_gains(
        bucket_counts(target, text=text, n=n, buckets=buckets), bucket_counts(docs, text=text, n=n, buckets=buckets)
    )
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").alias("text"))
    small_batches(spark)
    schema = T.StructType([*kept.schema.fields[:1], *[T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight")]])

    def weigh(batches):
        for batch in batches:
            for part in slices(batch):
                sums, sizes, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for doc, bucket, length in buckets_of(_texts(part), n, buckets):
                    sizes += np.bincount(doc, minlength=part.num_rows)
                    words += np.bincount(doc[length == 1], minlength=part.num_rows)
                    # Whole numbers far below 2 ** 53 in a block, so the sum is exact.
                    sums += np.bincount(doc, gains[bucket], minlength=part.num_rows).astype(np.int64)
                weight = np.where(sizes > 0, np.floor_divide(sums, np.maximum(sizes, 1)), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("kept"), pa.array(sizes), pa.array(words), pa.array(weight)], ["kept", "n_features", "n_words", "weight"]
                )

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"kept.`{key}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000.0 * F.log(-F.log((h.cast("long") + 0.5) / 4294967296.0)))
    # Written once: it is counted, sampled for its ranges and read.
    scored = written(kept.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise), "resample-scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    order = [F.col("score").desc(), F.col(f"kept.`{key}`").asc(), F.col("n_features").asc()]
    ranked = number_rows(eligible, [], order, "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(rest).select("kept.*", "n_features", "weight", "score", "rank")
