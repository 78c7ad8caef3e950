"""Benchmark decontamination by templates.

Texts become token sequences in which numbers, names and units are typed placeholders.  Windows of template tokens are
hashed and joined by hash with the windows of the benchmark.  Windows that lie alike in item and document are one
alignment; in it a value of the item should always stand for the same value of the document, while two values of the item
may become one.  Slots that break this are conflicts.  Numbers, names and units are judged apart: conflicts in up to half of
the slots of a kind are borne, beyond that the windows that hold them are left out, and only those.  So a question is found
as it is and with other numbers or names, while a text that only shares a pattern of placeholders is not.

Templates are blind to some copies: windows of mostly placeholders, short items, names that lost their capitals.  So each item
is cut a second time, into exact windows: over every visible character without case, where words are tokens, and so is each
sign and each character of a script that is written without spaces.  An item that is shorter than a window is one as a whole,
thus every item that is not blank has a window and its copies are found.

The document pass keeps no benchmark text: tasks get a bit table of fixed size, and only windows that pass it are joined.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import LOWER, flat, list_array, mix, shielded, signed, slices, small_batches, span_hashes
from vecloom.session import written

WINDOW = 8
# Shorter items are compared with windows of their own length, templates down to this.
SHORTEST = 5
# Aligned windows that make a match, or half of the item's if it has fewer.
WINDOWS_NEEDED = 5
# Tokens of a template window that must be no placeholders.
LITERALS = 3
# Conflicting slots of a kind that an alignment may have, as a share of its slots of that kind.
CONFLICTS = 0.5
SIEVE_BITS = 22
# Benchmark windows up to which the join is broadcast; beyond, it is a shuffle.
BROADCAST_WINDOWS = 200_000
# Units of measure and money, lower case.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres g mg kg lb lbs oz ton tons gram grams "
    "ml cl l liter liters litre litres gallon gallons s sec secs min mins h hr hrs second seconds minute minutes hour hours day days "
    "week weeks month months year years usd eur gbp dollar dollars euro euros pound pounds cent cents percent degrees kmh mph w kw v a hz"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(n) for n in (0x6E756D, 0x6E616D65, 0x756E6974))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_LETTER = np.zeros(256, bool)
for _low, _high in (("A", "Z"), ("a", "z")):
    _LETTER[ord(_low) : ord(_high) + 1] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n"]] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(span_hashes(data, ends - [len(u) for u in UNITS], ends))


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: the hash of each template token, the hash of its own text, its kind of placeholder (0 if none), and
    where each text begins."""
    raw, offsets = flat(texts)
    empty = np.zeros(0, np.uint64)
    if not len(raw):
        return empty, empty, np.zeros(0, np.int8), np.zeros(len(texts) + 1, np.int64)
    digit = _DIGIT[raw]
    inside = digit | _LETTER[raw]
    point = (raw == ord(".")) | (raw == ord(","))
    inside[1:-1] |= point[1:-1] & digit[:-2] & digit[2:]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    own = span_hashes(LOWER[raw], starts, ends)
    if not len(own):
        return empty, empty, np.zeros(0, np.int8), first

    number = digit[starts]
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    # A capital after the end of a sentence says nothing.
    fresh = np.ones(len(starts), bool)
    fresh[1:] = stops[starts[1:]] > stops[ends[:-1]]
    fresh[first[:-1][first[:-1] < len(starts)]] = True
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    lead = raw[starts]
    capital = _UPPER[lead] | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~fresh & (ends - starts >= 2) & ~_UPPER[second]
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = number[:-1]
    after_number[first[:-1][first[:-1] < len(starts)]] = False
    unit = after_number & ~number & np.isin(own, _unit_hashes())
    shape = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, own)))
    return shape, own, np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0))).astype(np.int8), first


def plain_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: the hash of each visible token without case, whether it is a character of a script without spaces, and
    where each text's begin."""
    low = pc.utf8_lower(texts)
    for form, same in (("ß", "ss"), ("ς", "σ")):
        low = pc.replace_substring(low, form, same)
    raw, offsets = flat(low)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
    inner = (raw & 0xC0) == 0x80
    leads = np.flatnonzero(~inner)
    lead, second = raw[leads], raw[np.minimum(leads + 1, len(raw) - 1)]
    # By lead bytes: Thai to Myanmar, Khmer, kana and ideographs, and what is beyond the first plane.
    spaceless = ((lead == 0xE0) & (second >= 0xB8)) | ((lead == 0xE1) & ((second <= 0x82) | (second == 0x9E) | (second == 0x9F)))
    spaceless |= ((lead >= 0xE3) & (lead <= 0xE9)) | (lead >= 0xF0)
    # Signs beyond ASCII, and wide forms.
    alone = (spaceless | (lead == 0xC2) | (lead == 0xE2) | (lead == 0xEF))[np.cumsum(~inner) - 1]
    word = (_LETTER[raw] | _DIGIT[raw]) & ~alone
    single = ~word & (raw > 0x20) & (raw != 0x7F)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after, more = np.zeros(len(raw), bool), np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1], more[:-1] = word[:-1], word[1:], inner[1:]
    starts = np.flatnonzero((word & (~before | edge[:-1])) | (single & ~inner))
    ends = np.flatnonzero((word & (~after | edge[1:])) | (single & ~more)) + 1
    of_script = np.zeros(len(raw), bool)
    of_script[leads] = spaceless
    return span_hashes(raw, starts, ends), of_script[starts], np.searchsorted(starts, offsets)


def _windows(texts: pa.Array, length: int, exact: bool) -> tuple[np.ndarray, ...]:
    """Hash, row, position of each window of ``length`` tokens, and the tokens it is made of; exact ones have no placeholders."""
    if exact:
        shape, _, first = plain_tokens(texts)
        own, kind = shape, np.zeros(len(shape), np.int8)
    else:
        shape, own, kind, first = templates(texts)
    n = len(shape) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), own, kind, np.zeros(0, np.int64)
    rolled, held = np.full(n, length + (exact << 20), np.uint64), np.zeros(n, np.int64)
    for k in range(length):
        rolled = rolled * _STEP + shape[k : k + n]
        held += kind[k : k + n] == 0
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    fits = (np.arange(n) + length <= first[row + 1]) & (held >= (0 if exact else LITERALS))
    at = np.flatnonzero(fits)
    return mix(rolled[at]), row[at], at - first[row[at]], own, kind, at


def _slots(kind: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens that are placeholders of each window, in order, where each window's begin, and their places in it."""
    index = at[:, None] + np.arange(length)
    held = kind[index] > 0 if len(at) else np.zeros((0, length), bool)
    return index[held], np.concatenate([[0], np.cumsum(held.sum(1))]), np.nonzero(held)[1]


def _emit(piece: pa.RecordBatch, key: list[str], length: int, exact: bool, sieve: np.ndarray | None) -> pa.RecordBatch:
    """Windows with the values of their slots; of items (no sieve) with the kinds and positions of these too."""
    hashes, row, position, own, kind, at = _windows(piece.column("text"), length, exact)
    if sieve is not None:
        cell = hashes & np.uint64((1 << SIEVE_BITS) - 1)
        hit = (sieve[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
        hashes, row, position, at = hashes[hit], row[hit], position[hit], at[hit]
    tokens, ends, places = _slots(kind, at, length)
    rows = pa.array(row)
    lists = {"slots": list_array(signed(own[tokens]), ends, pa.int64())}
    if sieve is None:
        lists["kinds"] = list_array(kind[tokens].astype(np.int32), ends, pa.int32())
        lists["places"] = list_array(np.repeat(position, np.diff(ends)) + places, ends, pa.int64())
    return pa.RecordBatch.from_arrays(
        [*(piece.column(k).take(rows) for k in key), pa.array(signed(hashes)), pa.array(position), *lists.values()], [*key, "window", "position", *lists]
    )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows ``at`` of each alignment that hold no conflict of a kind with too many, and whether a slot of them changed."""
    for batch in batches:
        kept, changed = [], []
        for length, at, slots in zip(*(batch.column(k).to_pylist() for k in ("length", "at", "pairs")), strict=True):
            votes: dict[tuple, Counter] = defaultdict(Counter)
            for slot in slots:
                votes[slot["kind"], slot["item"]][slot["doc"]] += 1
            most = {k: max(v, key=lambda doc: (v[doc], doc)) for k, v in votes.items()}
            odd, of = defaultdict(set), Counter(slot["kind"] for slot in slots)
            for slot in slots:
                if slot["doc"] != most[slot["kind"], slot["item"]]:
                    odd[slot["kind"]].add(slot["place"])
            bad = {place for kind, places in odd.items() if len(places) > CONFLICTS * of[kind] for place in places}
            kept.append([p for p in at if not any(p + k in bad for k in range(length))] if bad else at)
            covered = {p + k for p in kept[-1] for k in range(length)} if bad else None
            changed.append(any(s["item"] != s["doc"] and (covered is None or s["place"] in covered) for s in slots))
        names = [n for n in batch.schema.names if n not in ("length", "at", "pairs")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(changed, pa.bool_()), pa.array(kept, pa.list_(pa.int64()))], [*names, "changed", "at"])


def item_windows(benchmark: DataFrame, length: int = WINDOW, needed: int = WINDOWS_NEEDED) -> DataFrame:
    """(item_id, window, position, slots, kinds, places, exact, of, least, length): all windows of all items, templates and exact.

    ``of`` is the number of such windows an item has, ``least`` how many make a match: ``needed``, or half of them if those are
    fewer, and always half of the exact ones of an item in a script without spaces, as its windows are a few words only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(len(batch)):
                    piece = batch.slice(at, 1)
                    for exact in (False, True):
                        tokens, script = plain_tokens(piece.column("text"))[:2] if exact else (templates(piece.column("text"))[0], None)
                        own = min(length, len(tokens))
                        if own < (1 if exact else SHORTEST):
                            continue
                        found = _emit(piece, ["item_id"], own, exact, None)
                        of = len(found)
                        half = -(-of // 2)
                        least = half if exact and 2 * script.sum() > len(tokens) else min(needed, half)
                        values = [(exact, pa.bool_()), (of, pa.int64()), (least, pa.int64()), (own, pa.int32())]
                        yield pa.RecordBatch.from_arrays(
                            [*found.columns, *(pa.array([v] * of, t) for v, t in values)], [*found.schema.names, "exact", "of", "least", "length"]
                        )

    return benchmark.select("item_id", "text").where("text is not null").mapInArrow(
        cut,
        "item_id long, window long, position long, slots array<long>, kinds array<int>, places array<long>, "
        "exact boolean, of long, least long, length int",
    )


def _sieve(windows: DataFrame) -> np.ndarray:
    """The hashes of all windows as bits of a table of fixed size."""
    size = 1 << SIEVE_BITS
    cells = windows.select(F.pmod("window", F.lit(size)).cast("int").alias("cell")).distinct().toArrow().column("cell").to_numpy()
    bits = np.zeros(size >> 3, np.uint8)
    np.bitwise_or.at(bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
    return bits


def find_leaks(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, needed: int = WINDOWS_NEEDED) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, share, changed): the documents that hold an item, and how much of it.

    ``docs`` has (doc_id, text, ...), ``benchmark`` (item_id, text, ...); other columns are not read.  ``n_windows`` counts
    the item's windows found in alignments, without those left out for conflicts, ``share`` is their part of all, ``changed``
    tells whether a slot has another value than in the item.  Of template and exact windows those count whose share is larger.
    A template window needs ``LITERALS`` tokens that are no placeholders, and a name is told by its capital, in item and
    document alike; exact windows need neither.  An item of fewer than ``length`` visible tokens is found wherever they stand
    in a row, so a benchmark should hold no item of a single common word.  Null, empty and blank texts hold nothing.  Rows that
    repeat id and text are one; a null id is a value of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = written(item_windows(benchmark, length, needed), "leak-windows")
    series = sorted((r["exact"], r["length"]) for r in windows.select("exact", "length").distinct().collect())
    sieve = spark.sparkContext.broadcast(_sieve(windows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in slices(batch):
                    for exact, own in series:
                        yield _emit(piece, ["doc_id", "text_key"], own, exact, sieve.value)

    hits = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        scan, "doc_id long, text_key long, window long, position long, slots array<long>"
    )
    few = windows.count() <= BROADCAST_WINDOWS
    items = windows.select("window", "item_id", "exact", "of", "least", "length", "kinds", "places", F.col("position").alias("item_position"), F.col("slots").alias("item_slots"))
    met = hits.join(F.broadcast(items) if few else items, "window")
    pairs = F.arrays_zip(F.col("places").alias("place"), F.col("kinds").alias("kind"), F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    aligned = (
        met.where(F.size("slots") == F.size("item_slots"))
        .withColumn("shift", F.col("position") - F.col("item_position"))
        .groupBy("doc_id", "text_key", "item_id", "exact", "of", "least", "length", "shift")
        # An alignment holds an item's windows once, so its sets are as long as the item.
        .agg(F.collect_set("item_position").alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    )
    found = (
        aligned.drop("shift")
        .mapInArrow(_agreeing, "doc_id long, text_key long, item_id long, exact boolean, of long, least long, changed boolean, at array<long>")
        .withColumn("at", F.explode("at"))
        .groupBy("doc_id", "text_key", "item_id", "exact", "of", "least")
        .agg(F.countDistinct("at").alias("n_windows"), F.max("changed").alias("changed"))
        .where("n_windows >= least")
    )
    # The template windows come first where both are found to the same share.
    best = F.max(F.struct((F.col("n_windows") / F.col("of")).alias("share"), (~F.col("exact")).alias("template"), "n_windows")).alias("best")
    found = found.groupBy("doc_id", "text_key", "item_id").agg(best, F.max("changed").alias("changed"))
    return found.select("doc_id", "text_key", "item_id", "best.n_windows", "best.share", "changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns, whatever their names, and other rows stay as they are.

    Null and empty texts hold none and stay; repeated rows stay or go together, rows without an id by their text.
    """
    return shielded(docs, ("_id", "_key", "_text_key"), lambda rows: _without_leaks(rows, benchmark))


def _without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    return keyed.join(leaks, same, "left_anti").drop("_text_key")
