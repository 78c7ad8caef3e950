"""Language identification of spans.

The script of a word narrows the languages that come into question; character trigrams score it under each of them; a
Viterbi pass over the words of a text, with a penalty for each switch, labels its spans.  The languages and all counts are
learned from every given row.  The passes of many texts advance together, word by word, in arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import mix, slices, small_batches

CELLS = 1 << 16
SMOOTHING = 0.5
# What a change of language costs, in nats.
SWITCH = 12.0
# A language whose letters are of a script less often than this is no candidate for its words.
SCRIPT_SHARE = 0.01
NO_CANDIDATE = -1000.0
# Bytes of text whose words take their Viterbi steps together; more make fewer steps and use more memory.
STEP_BYTES = 3 << 19
UNKNOWN = "und"

# Where the blocks of scripts begin and end (Unicode).
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
)
_tables: dict[str, np.ndarray] = {}


def _codes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower-case form, whether it is of a word (letter or mark), its script (0: other)."""
    if not _tables:
        low, word, script = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            kind = unicodedata.category(chr(code))
            if kind[0] == "L":
                word[code] = 1
                lower = chr(code).lower()
                low[code] = ord(lower) if len(lower) == 1 else code
            elif kind[0] == "M":
                word[code] = 2
        for at, (_, blocks) in enumerate(SCRIPTS, 1):
            for start, end in blocks:
                script[start : end + 1] = at
        _tables.update(low=low, word=word, script=script)
    return _tables["low"], _tables["word"], _tables["script"]


class _Words:
    """The words of many texts: trigram cells with the word each is of, and each word's place, letters and script."""

    def __init__(self, texts: list[str]):
        low, kind, script = _codes()
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        letter, inside = kind[codes] == 1, kind[codes] > 0
        before = np.concatenate([[False], inside[:-1]])
        # A word begins with a letter; marks before a run's first letter are none of it.
        heads = inside & ~before
        if heads.any():
            seen = np.cumsum(letter)
            inside &= seen > (seen - letter)[heads][np.cumsum(heads) - 1]
        before = np.concatenate([[False], inside[:-1]])
        heads = inside & ~before
        word_of = np.cumsum(heads) - 1
        starts = np.flatnonzero(heads)
        ends = np.flatnonzero(before & ~inside)
        real = letter[starts] if len(starts) else np.zeros(0, bool)
        self.first = np.searchsorted(starts[real], begins)
        number = np.cumsum(real) - 1
        at = np.flatnonzero(inside | before)
        at = at[real[word_of[at]]] if len(starts) else at[:0]
        self.word = number[word_of[at]] if len(at) else at
        self.starts, self.ends = starts[real] - begins[:-1].repeat(np.diff(self.first)), ends[real] - begins[:-1].repeat(np.diff(self.first))
        symbol = np.where(inside, low[codes], 1).astype(np.uint64)
        since = at - starts[real][self.word] if len(at) else at
        grams = symbol[at]
        for k in (1, 2):
            grams |= np.where(since >= k, symbol[np.maximum(at - k, 0)], np.uint64(0)) << np.uint64(21 * k)
        with np.errstate(over="ignore"):
            self.cells = (mix(grams) & np.uint64(CELLS - 1)).astype(np.int64)
        letters = np.concatenate([[0], np.cumsum(letter)])
        self.letters = letters[ends[real]] - letters[starts[real]]
        self.script = script[codes[starts[real]]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for piece in slices(batch):
            words = _Words([t or "" for t in piece.column("text").to_pylist()])
            langs = np.array(piece.column("lang").to_pylist(), object)
            of_word = np.repeat(np.arange(len(langs)), np.diff(words.first))
            for lang in set(langs):
                own = (langs == lang)[of_word]
                held = counts.setdefault(lang, np.zeros(CELLS + len(SCRIPTS) + 1, np.int64))
                held[:CELLS] += np.bincount(words.cells[own[words.word]], minlength=CELLS)
                held[CELLS:] += np.bincount(words.script[own], words.letters[own], len(SCRIPTS) + 1).astype(np.int64)
    for lang, held in counts.items():
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells, pa.int32()), pa.array(held[cells])], ["lang", "cell", "n"])


def _best_paths(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; all texts take their n-th step together."""
    counts = np.diff(first)
    label = np.zeros(len(score), np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return label
    n_active = np.searchsorted(-counts[order], -np.arange(counts.max()), side="left")
    back = np.zeros(score.shape, np.int16)
    value = score[first[order]].copy()
    ids, all_rows = np.arange(score.shape[1]), np.arange(len(order))
    for step in range(1, counts.max()):
        active = order[: n_active[step]]
        at = first[active] + step
        old = value[: len(active)]
        best = old.argmax(1)
        top = old[all_rows[: len(active)], best][:, None] - switch
        back[at] = np.where(old >= top, ids, best[:, None])
        value[: len(active)] = np.maximum(old, top) + score[at]
    state = value.argmax(1)
    last = first[order] + counts[order] - 1
    label[last] = state
    for step in range(counts.max() - 1, 0, -1):
        at = first[order[: n_active[step]]] + step
        label[at - 1] = back[at, label[at]]
    return label


class LanguageModel:
    def __init__(self, langs: list[str], counts: np.ndarray, switch: float = SWITCH):
        self.langs, self.switch = langs, switch
        grams = counts[:, :CELLS] + SMOOTHING
        self.weights = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32).copy()
        scripts = counts[:, CELLS:] / np.maximum(counts[:, CELLS:].sum(1, keepdims=True), 1)
        fits = (scripts >= SCRIPT_SHARE).T
        self.narrow = np.where(fits | ~fits.any(1, keepdims=True), 0.0, NO_CANDIDATE)

    def label(self, texts: list[str]) -> tuple[list[str], list[float], list[list[dict]]]:
        """For each text its main language (most letters; ties: first name), its share, and the spans."""
        words = _Words(texts)
        n = len(words.starts)
        score = np.column_stack([np.bincount(words.word, self.weights[words.cells, k], n) for k in range(len(self.langs))]) + self.narrow[words.script]
        label = _best_paths(score, words.first, self.switch)
        row = np.repeat(np.arange(len(texts)), np.diff(words.first))
        letters = np.zeros((len(texts), len(self.langs)))
        np.add.at(letters, (row, label), words.letters)
        total = letters.sum(1)
        main = letters.argmax(1)
        heads = np.ones(n, bool)
        heads[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
        begin = np.flatnonzero(heads)
        end = np.append(begin[1:], n)[: len(begin)] - 1
        spans: list[list[dict]] = [[] for _ in texts]
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            spans[row[a]].append({"start": int(words.starts[a]), "end": int(words.ends[b]), "lang": self.langs[label[a]]})
        langs = [self.langs[m] if t else UNKNOWN for m, t in zip(main, total, strict=True)]
        return langs, np.where(total > 0, letters[np.arange(len(texts)), main] / np.maximum(total, 1), 0.0).tolist(), spans


def fit_language(rows: DataFrame) -> LanguageModel | None:
    """Learn from ``rows`` (text, lang); rows without a language are left out.  None if nothing is left."""
    small_batches(rows.sparkSession)
    counted = (
        rows.where("lang is not null and text is not null")
        .select("text", "lang")
        .mapInArrow(_count, "lang string, cell int, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = counted.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return None
    number = {lang: k for k, lang in enumerate(langs)}
    counts = np.zeros((len(langs), CELLS + len(SCRIPTS) + 1))
    counts[[number[x] for x in names], counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return LanguageModel(langs, counts)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its share of the letters) and ``spans`` (start, end, lang; code points).

    A null text, one without letters, and any text without a model is ``und`` with score 0 and no spans.  Every row is
    labelled; ``docs`` must have a column ``text`` and none of the new names; other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=STEP_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                langs, shares, spans = sent.value.label(texts) if sent.value else ([UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(langs), pa.array(shares), pa.array(spans, kind)], [*piece.schema.names, "lang_pred", "score", "spans"]
                )

    return docs.mapInArrow(labelled, f"{fields}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
