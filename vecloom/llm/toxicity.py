"""Toxicity by two Kneser-Ney models of characters within words, one of toxic and one of ordinary texts.

Each class has its own counts of the longest n-grams; both back off to the same chain of continuation counts, so a
rare expression is judged by the parts that it shares with others.  A text is scored by the difference of its two
log-likelihoods, divided by its length, over the whole text and over its most toxic word; a logistic curve fitted on
texts that the counts have not seen turns the two into a number from 0 to 1.

Counts come from every learned row, and every n-gram stays in the model, however rare.  A table of up to
``BROADCAST_NGRAMS`` n-grams is sent to the tasks.  A larger one stays a Spark table: the same ratios are worked out by
joins and windows, and texts are scored in blocks, whose distinct n-grams are joined with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.base import discard, flat, shielded, slices, small_batches
from vecloom.llm.lookup import Lookup
from vecloom.session import written

ORDER = 6
BITS = 10
# n-grams up to which the model is broadcast; beyond, it is joined.
BROADCAST_NGRAMS = 1 << 20
# Texts that are joined with a larger model together, about.
BLOCK_BYTES = 8 << 20
# Learned rows that the logistic curve is fitted on, at most.
CALIBRATION_ROWS = 20_000
DISCOUNT = 0.75
PREDICT_FROM = 0.3
_END = 1
_tables: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter or digit; letters without case."""
    if "symbols" not in _tables:
        table = np.zeros(0x110000, np.uint16)
        for code in range(0x110000):
            if 0xD800 <= code < 0xE000 or not chr(code).isalnum():
                continue
            low = chr(code).lower()
            low = ord(low) if len(low) == 1 else code
            table[code] = 2 + low if low < 0x250 else 596 + low % 420
        _tables["symbols"] = table
    return _tables["symbols"]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of all words of all texts, the word that each belongs to, and where each text's words begin."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbol = _symbols()[codes].astype(np.uint64)
    letter = symbol > 0
    before = np.concatenate([[False], letter[:-1]])
    begin = np.flatnonzero(letter & ~before)
    at = np.flatnonzero(letter | before)
    word = np.cumsum(letter & ~before)[at] - 1
    symbol[~letter] = _END
    since = at - begin[word] if len(begin) else at
    grams = symbol[at]
    for k in range(1, ORDER):
        grams |= np.where(since >= k, symbol[np.maximum(at - k, 0)], np.uint64(0)) << np.uint64(BITS * k)
    return grams, word, np.searchsorted(begin, starts)


def _merge(parts: list) -> list:
    grams = np.concatenate([p[0] for p in parts])
    kinds, inverse = np.unique(grams, return_inverse=True)
    return [(kinds, *(np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(kinds)).astype(np.int64) for k in (1, 2)))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams with their counts in toxic and in ordinary texts, added up within bounds."""
    parts: list = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        (grams, toxic, ordinary) = _merge(parts)[0]
        for at in range(0, len(grams), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[cut].view(np.int64)), pa.array(toxic[cut]), pa.array(ordinary[cut])], ["gram", "toxic", "ordinary"]
            )

    for batch in batches:
        for piece in slices(batch):
            grams, word, first = _grams([t or "" for t in piece.column("text").to_pylist()])
            if not len(grams):
                continue
            labels = np.repeat(piece.column("label").to_numpy(zero_copy_only=False) > 0, np.diff(first))[word]
            kinds, inverse = np.unique(grams, return_inverse=True)
            parts.append((kinds, np.bincount(inverse, labels, len(kinds)), np.bincount(inverse, ~labels, len(kinds))))
            size += len(kinds)
            if size > 1_000_000:
                parts = _merge(parts)
                size = len(parts[0][0])
            if size > 800_000:
                yield from out()
                parts, size = [], 0
    if parts:
        yield from out()


def _sum_by(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    _, inverse = np.unique(keys, return_inverse=True)
    return np.bincount(inverse, values)[inverse]


class KneserNey:
    """Log-likelihood ratios of the n-grams, and of unseen n-grams by their history."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        top = np.uint64(BITS)
        kinds, lower = [grams], []
        for k in range(ORDER - 1, 0, -1):
            found, counts = np.unique(kinds[-1] & np.uint64((1 << (BITS * k)) - 1), return_counts=True)
            kinds.append(found)
            lower.append((found, counts.astype(float)))
        lower.reverse()
        found, counts = lower[0]
        shared = counts / counts.sum()
        for k in range(1, ORDER - 1):
            down = shared[np.searchsorted(found, lower[k][0] & np.uint64((1 << (BITS * k)) - 1))]
            found, counts = lower[k]
            shared = self._step(found >> top, counts, down)
        down = shared[np.searchsorted(found, grams & np.uint64((1 << (BITS * (ORDER - 1))) - 1))]
        past = grams >> top
        ratio = np.log(self._step(past, toxic, down)) - np.log(self._step(past, ordinary, down))
        pasts, first = np.unique(past, return_index=True)
        unseen = (np.log(self._weight(past, toxic)) - np.log(self._weight(past, ordinary)))[first]
        self.grams = Lookup(grams, ratio.astype(np.float32))
        self.pasts = Lookup(pasts, unseen.astype(np.float32))

    @staticmethod
    def _weight(past: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a history leaves to the backoff; all, if it was never seen."""
        total = _sum_by(past, counts)
        kinds = _sum_by(past, (counts > 0).astype(float))
        return np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)

    def _step(self, past: np.ndarray, counts: np.ndarray, down: np.ndarray) -> np.ndarray:
        total = _sum_by(past, counts)
        return np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1) + self._weight(past, counts) * down

    def ratios(self, grams: np.ndarray) -> np.ndarray:
        ratio, known = self.grams.get(grams)
        new = np.flatnonzero(~known)
        ratio[new] = self.pasts.get(grams[new] >> np.uint64(BITS))[0]
        return ratio


def _features(texts: list[str], ratios: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each text: ratio for each character of it all, of its most toxic word, and of the next one; 0 if empty."""
    grams, word, first = _grams(texts)
    out = np.zeros((len(texts), 3))
    if not len(grams):
        return out
    words = np.bincount(word, ratios(grams))
    sizes = np.bincount(word)
    sums = np.concatenate([[0], np.cumsum(words)])
    chars = np.concatenate([[0], np.cumsum(sizes)])
    some = np.diff(first) > 0
    out[some, 0] = ((sums[first[1:]] - sums[first[:-1]]) / np.maximum(chars[first[1:]] - chars[first[:-1]], 1))[some]
    for row in np.flatnonzero(some):
        own = words[first[row] : first[row + 1]]
        best = int(np.argmax(own))
        out[row, 1] = own[best]
        out[row, 2] = max(own[:best].max(initial=0), own[best + 1 :].max(initial=0))
    return out


class RatioTables:
    """The ratios of ``KneserNey`` as Spark tables: (gram, ratio) and (past, unseen).

    A history has at most as many n-grams as there are symbols, and so has a suffix; no window or join key is larger.
    """

    def __init__(self, counts: DataFrame):
        kinds, levels = counts, {}
        for k in range(ORDER - 1, 0, -1):
            kinds = written(kinds.groupBy(self._suffix(k).alias("gram")).agg(F.count("*").alias("n")), "toxic-kinds")
            levels[k] = kinds
        total = levels[1].agg(F.sum("n")).first()[0]
        shared = levels[1].select("gram", (F.col("n") / F.lit(total)).alias("p"))
        for k in range(2, ORDER):
            shared = self._with_down(levels[k], shared, k - 1).select("gram", self._step("n").alias("p"))
        held = self._with_down(counts, shared, ORDER - 1)
        ratio = F.log(self._step("toxic")) - F.log(self._step("ordinary"))
        self.grams = written(held.select("gram", ratio.cast("float").alias("ratio")), "toxic-ratios")
        pasts = counts.groupBy(self._past().alias("past")).agg(
            *(f.alias(f"{name}_{n}") for n in ("toxic", "ordinary") for name, f in (("sum", F.sum(n)), ("kinds", F.sum((F.col(n) > 0).cast("long")))))
        )
        unseen = F.log(self._left(F.col("sum_toxic"), F.col("kinds_toxic"))) - F.log(self._left(F.col("sum_ordinary"), F.col("kinds_ordinary")))
        self.pasts = written(pasts.select("past", unseen.cast("float").alias("unseen")), "toxic-pasts")
        discard(*levels.values())

    @staticmethod
    def _suffix(k: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))

    @staticmethod
    def _past() -> Column:
        return F.shiftrightunsigned("gram", BITS)

    @staticmethod
    def _left(total: Column, kinds: Column) -> Column:
        return F.when(total > 0, DISCOUNT * kinds / total).otherwise(1.0)

    def _with_down(self, level: DataFrame, shared: DataFrame, k: int) -> DataFrame:
        """``level`` with ``past`` and the probability ``down`` of each n-gram's last ``k`` symbols."""
        down = shared.select(F.col("gram").alias("_suffix"), F.col("p").alias("down"))
        return level.withColumn("_suffix", self._suffix(k)).join(down, "_suffix").withColumn("past", self._past())

    def _step(self, name: str) -> Column:
        counts, window = F.col(name), Window.partitionBy("past")
        total, kinds = F.sum(counts).over(window), F.sum((counts > 0).cast("long")).over(window)
        return F.greatest(counts - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1)) + self._left(total, kinds) * F.col("down")

    def with_features(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """``docs`` with the features x0, x1 and x2.  Rows are numbered by blocks; a block meets only the n-grams it has."""
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, size = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                for piece in slices(batch):
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.full(len(piece), block))], [*piece.schema.names, "_block"])
                    size += flat(piece.column("text"))[1][-1]
                    if size >= block_bytes:
                        block, size = block + 1, 0

        def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for block, grams in held.items():
                    for at in range(0, len(grams), 50_000):
                        cut = grams[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), block)), pa.array(cut.view(np.int64))], ["_block", "gram"])

            for batch in batches:
                for piece in slices(batch):
                    texts, blocks = piece.column("text").to_pylist(), piece.column("_block").to_numpy()
                    for block in np.unique(blocks).tolist():
                        grams = _grams([texts[k] or "" for k in np.flatnonzero(blocks == block)])[0]
                        if block not in held:
                            yield from out()
                            held = {}
                        held[block] = np.union1d(held.get(block, np.zeros(0, np.uint64)), grams)
            yield from out()

        def scored(rows: pa.Table, known: pa.Table) -> pa.Table:
            grams, first = np.unique(known.column("gram").to_numpy().view(np.uint64), return_index=True)
            lookup = Lookup(grams, known.column("ratio").to_numpy()[first])
            parts = []
            for batch in rows.drop_columns(["_block"]).combine_chunks().to_batches():
                for piece in slices(batch):
                    x = _features([t or "" for t in piece.column("text").to_pylist()], lambda g: lookup.get(g)[0])
                    parts.append(pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(x[:, k]) for k in range(3))], [*piece.schema.names, "x0", "x1", "x2"]))
            return pa.Table.from_batches(parts)

        rows = written(docs.mapInArrow(number, ", ".join([*fields, "_block long"])), "toxic-blocks")
        met = rows.select("text", "_block").mapInArrow(kinds, "_block long, gram long").join(self.grams, "gram", "left")
        # n-grams that are known need no history; their keys match none and are spread.
        past = F.when(F.col("ratio").isNull(), self._past()).otherwise(-1 - F.pmod(F.xxhash64("gram"), F.lit(1 << 20)))
        met = met.withColumn("past", past).join(self.pasts, "past", "left")
        known = met.select("_block", "gram", F.coalesce("ratio", "unseen").alias("ratio")).where("ratio is not null")
        return rows.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(scored, ", ".join([*fields, "x0 double, x1 double, x2 double"]))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the constant), means and scales, by Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + 0.1 * w
        bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def _with_features(docs: DataFrame, model: KneserNey | RatioTables) -> DataFrame:
    """``docs`` with the features x0, x1 and x2 of the column ``text``."""
    if isinstance(model, RatioTables):
        return model.with_features(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                x = _features([t or "" for t in piece.column("text").to_pylist()], sent.value.ratios)
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(x[:, k]) for k in range(3))], [*piece.schema.names, "x0", "x1", "x2"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["x0 double, x1 double, x2 double"])
    return docs.mapInArrow(features, schema)


class ToxicModel:
    def __init__(self, model: KneserNey | RatioTables | None, curve, base: float):
        self.model, self.curve, self.base = model, curve, base

    def score(self) -> Column:
        """The score from the features."""
        w, mean, scale = self.curve
        z = F.lit(float(w[-1]))
        for k in range(3):
            z = z + (F.col(f"x{k}") - float(mean[k])) / float(scale[k]) * float(w[k])
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def fit_toxicity(labelled: DataFrame, broadcast_ngrams: int = BROADCAST_NGRAMS, calibration_rows: int = CALIBRATION_ROWS) -> ToxicModel:
    """Learn from ``labelled`` (text, label 0 or 1, part): rows of part 0 are counted, those of part 1 fit the curve.

    Rows whose label is null are left out.  Without rows of both labels every score is the share of label 1.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("label is not null").select("text", F.col("label").cast("int").alias("label"), "part")
    rows = written(rows, "toxic-rows")
    shares = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    base = sum(n for (_, label), n in shares.items() if label) / total if total else 0.0
    if not all(shares.get((part, label)) for part in (0, 1) for label in (0, 1)):
        return ToxicModel(None, None, base)
    counts = (
        rows.where("part = 0")
        .select("text", "label")
        .mapInArrow(_count, "gram long, toxic long, ordinary long")
        .groupBy("gram")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    counts = written(counts, "toxic-counts")
    if counts.count() <= broadcast_ngrams:
        held = counts.toArrow()
        model = KneserNey(
            held.column("gram").to_numpy().astype(np.int64).view(np.uint64),
            held.column("toxic").to_numpy().astype(float),
            held.column("ordinary").to_numpy().astype(float),
        )
    else:
        model = RatioTables(counts)
    sample = _with_features(rows.where("part = 1").select("text", "label"), model).select("label", "x0", "x1", "x2")
    found = sample.orderBy(F.xxhash64("x0", "x1", "x2"), "label").limit(calibration_rows).toArrow()
    x = np.column_stack([found.column(f"x{k}").to_numpy() for k in range(3)])
    discard(rows, counts)
    return ToxicModel(model, _logistic(x, found.column("label").to_numpy().astype(float)), base)


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; every row is scored, a null text as an empty one.

    ``docs`` must have a column ``text`` and none of the two new names; other columns, whatever their names, stay as they are.
    """
    return shielded(docs, ("x0", "x1", "x2", "_block"), lambda rows: _score_toxicity(rows, model))


def _score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    small_batches(docs.sparkSession)
    if model.model is None or model.curve is None:
        scored = docs.withColumn("score", F.lit(float(model.base)))
    else:
        scored = _with_features(docs, model.model).withColumn("score", model.score()).drop("x0", "x1", "x2")
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))
