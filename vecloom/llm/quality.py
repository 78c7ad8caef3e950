"""Quality by Naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of n-grams of words and of word shapes, hashed into a fixed number of cells.  Each is scaled by its
log-count ratio between the classes, counted over every learned row; a linear hinge-loss model over the scaled and
normalised features is fitted by dual coordinate descent on at most ``FIT_ROWS`` rows, and its margin becomes a number
from 0 to 1 by a logistic curve fitted on rows that neither has seen (``CURVE_ROWS`` at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import discard, flat, list_array, mix, slices, small_batches, span_hashes, word_spans
from vecloom.llm.toxicity import _logistic
from vecloom.session import written

CELL_BITS = 18
FIT_ROWS = 6_000
CURVE_ROWS = 6_000
SMOOTHING = 1.0
EPOCHS = 12
PREDICT_FROM = 0.3

_STEP = np.uint64(0xD6E8FEB86659FD93)
_KIND = np.full(256, 1 << 11, np.uint16)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
for _at, _sign in enumerate("!?*#%&$|"):
    _KIND[ord(_sign)] = 8 << _at


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different cells of each text's n-grams, and where each text's begin."""
    data, offsets = flat(texts)
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    words = span_hashes(data, starts, ends)
    shape = np.bitwise_or.reduceat(_KIND[data], starts).astype(np.uint64)
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    shape |= same << np.uint64(16)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    grams, rows = [words, mix(shape + np.uint64(1))], [row, row]
    for series, longest in ((words, 2), (shape, 3)):
        rolled = series + np.uint64(longest)
        for k in range(1, longest):
            rolled = rolled[:-1] * _STEP + series[k:]
            inside = row[: len(rolled)] == row[k:]
            grams.append(mix(rolled[inside] + np.uint64(k)))
            rows.append(row[: len(rolled)][inside])
    cells = np.concatenate(grams) & np.uint64((1 << CELL_BITS) - 1)
    both = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(CELL_BITS)) | cells)
    at = np.searchsorted(both, np.arange(len(texts) + 1).astype(np.uint64) << np.uint64(CELL_BITS))
    return (both & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << CELL_BITS), np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in slices(batch):
                cells, at = features(piece.column("text"))
                label = np.repeat(piece.column("label").to_numpy(zero_copy_only=False) > 0, np.diff(at))
                for k, own in enumerate((cells[~label], cells[label])):
                    counts[k] += np.bincount(own, minlength=1 << CELL_BITS)
    held = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int32()), pa.array(counts[0][held]), pa.array(counts[1][held])], ["cell", "zeros", "ones"]
    )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in slices(batch):
                cells, at = features(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("label"), list_array(cells, at, pa.int32())], ["label", "cells"])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, cost: float = 1.0) -> np.ndarray:
    """Weights of the hinge-loss model (Hsieh et al., 2008); the classes weigh the same."""
    y = np.where(labels > 0, 1.0, -1.0)
    bound = cost * np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1))
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows]
    square = np.array([v @ v for v in values]) + 1.0
    weights, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        for i in draw.permutation(len(y)):
            slope = y[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return np.append(weights, bias)


class QualityModel:
    def __init__(self, ratio, weights, curve, base: float):
        self.ratio, self.weights, self.curve, self.base = ratio, weights, curve, base

    def margins(self, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        own = self.ratio[cells]
        norm = np.sqrt(np.bincount(row, own * own, len(at) - 1))
        return np.bincount(row, own * self.weights[cells], len(at) - 1) / np.maximum(norm, 1e-9) + self.weights[-1]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        w, mean, scale = self.curve
        z = (self.margins(*features(texts))[:, None] - mean) / scale
        return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))


def fit_quality(labelled: DataFrame, fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS) -> QualityModel:
    """Learn from ``labelled`` (text, label 0 or 1, part): part 0 for ratios and margin, part 1 for the curve.

    Rows whose label is null are left out.  Without rows of both labels every score is the share of label 1.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("label is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), "part")
    rows = written(rows, "quality-rows")
    shares = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    base = sum(n for (_, label), n in shares.items() if label) / total if total else 0.0
    if not all(shares.get((part, label)) for part in (0, 1) for label in (0, 1)):
        return QualityModel(None, None, None, base)
    counted = (
        rows.where("part = 0")
        .select("text", "label")
        .mapInArrow(_count, "cell int, zeros long, ones long")
        .groupBy("cell")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
        .toArrow()
    )
    sides = []
    for name in ("ones", "zeros"):
        side = np.full(1 << CELL_BITS, SMOOTHING)
        side[counted.column("cell").to_numpy()] += counted.column(name).to_numpy()
        sides.append(np.log(side / side.sum()))
    ratio = sides[0] - sides[1]

    def drawn(part: int, most: int) -> tuple[list[np.ndarray], np.ndarray]:
        few = rows.where(F.col("part") == part).select("text", "label").orderBy(F.xxhash64("text"), "label").limit(most)
        found = few.mapInArrow(_listed, "label int, cells array<int>").toArrow()
        cells = found.column("cells").combine_chunks()
        ends = cells.offsets.to_numpy()
        flat_cells = cells.values.to_numpy().astype(np.int64)
        return [flat_cells[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], found.column("label").to_numpy()

    model = QualityModel(ratio, dual_descent(*drawn(0, fit_rows), ratio), None, base)
    own, labels = drawn(1, curve_rows)
    at = np.cumsum([0, *map(len, own)])
    model.curve = _logistic(model.margins(np.concatenate(own), at)[:, None], labels.astype(float))
    discard(rows)
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; every row is scored, a null text as an empty one.

    ``docs`` must have a column ``text`` and none of the two new names; other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in slices(batch):
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(sent.value.scores(piece.column("text")))], [*piece.schema.names, "score"])

    return docs.mapInArrow(scored, f"{fields}, score double").withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
