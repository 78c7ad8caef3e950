"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text into chunks whose borders depend on nearby bytes only, so texts that share a
passage share its chunks.  Documents with the same least chunk hash are brought together (by a rebalancing shuffle, which
splits large groups), and a worker encodes each different chunk once.  A chunk's encoding is kept apart from its ragged
ends; at a join the words on both sides of the cut are encoded anew as one, and the window grows over whole chunks up
to white space.  Agreement is not compared: the tokenizer must drop ASCII white space and never look across it, which is
checked when it is loaded.
Within a chunk, words met before are not encoded again.  A worker outlives the stage, and what it remembers stays beside the
work of later stages: chunks go at the end of a task, and when there are too many words only those met time and again stay.

The vocabulary is read from the given path by every task, so the file must be on the workers.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.base import SPACE, _BYTE, _power, flat, list_array, mix, slices, small_batches

# A cut every so many bytes in the mean, from a hash over so many bytes.
CHUNK_BYTES = 512
ROLL_BYTES = 24
# What a worker remembers: words (some 200 bytes each) and their bytes, and bytes of chunks.
MOST_WORDS = 1_200_000
MOST_WORD_BYTES = 32 << 20
MOST_CHUNK_BYTES = 32 << 20


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of all texts begin (and the end of the last), and the hash that made each cut (0 at a text's start)."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    n = len(data) - ROLL_BYTES + 1
    starts, ends = offsets[:-1][np.diff(offsets) > 0], offsets[-1:]
    if n <= 0:
        return np.concatenate([starts, ends]), np.zeros(len(starts) + 1, np.uint64)
    rolled = mix((sums[ROLL_BYTES:] - sums[:n]) * down[:n])
    cut = np.flatnonzero(rolled % np.uint64(CHUNK_BYTES) == 0)
    found = rolled[cut]
    # The hash covers the bytes before the cut; all of them must be of the text, and a character stays whole.
    at = cut + ROLL_BYTES
    text = np.searchsorted(offsets, cut, side="right") - 1
    keep = at < offsets[text + 1]
    keep[keep] &= (data[at[keep]] & 0xC0) != 0x80
    both = np.concatenate([starts, at[keep], ends])
    hashes = np.concatenate([np.zeros(len(starts), np.uint64), found[keep], np.zeros(1, np.uint64)])
    order = np.argsort(both, kind="stable")
    return both[order], hashes[order]


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the least cut hash of each text, or a hash of all of it if it has none: near copies mostly agree in it."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in slices(batch):
                data, offsets = flat(piece.column("text"))
                cuts, hashes = chunk_cuts(data, offsets)
                least = np.full(len(piece), np.iinfo(np.int64).max)
                made = hashes > 0
                rows = np.searchsorted(offsets, cuts[made], side="right") - 1
                np.minimum.at(least, rows, (hashes[made] >> np.uint64(1)).view(np.int64))
                whole = np.flatnonzero(least == np.iinfo(np.int64).max)
                for row in whole:
                    own = data[offsets[row] : offsets[row + 1]].tobytes()
                    least[row] = int.from_bytes(hashlib.blake2b(own, digest_size=7).digest(), "big")
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(least)], [*piece.schema.names, "_place"])


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array, or a larger one that begins like it, with room for ``n`` values."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


class ChunkEncoder:
    """Encodes texts chunk by chunk and remembers words and chunks within bounds."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._check_spaces(path)
        self.most_words = most_words
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = 0
        self._forget()

    def _check_spaces(self, path: str) -> None:
        """Words are encoded alone, so the tokenizer must drop ASCII white space and not look across it; else an error."""
        spaces = [chr(c) for c in np.flatnonzero(SPACE)]
        split, normalizer = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        wide = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if any(c in t.content for c in spaces)]
        sound = split is not None and not wide

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        for gap in [*spaces, "  ", " \n\t "] if sound else []:
            for a, b in (("the", "end"), ("A", "'s"), ("7", "8"), ("?", "!"), ("é", "é"), ("x1", "(y")):
                text = f"{gap}{a}{gap}{b}{gap}"
                plain = normalizer.normalize_str(text) if normalizer else text
                held = any(plain[i].isspace() for _, (start, end) in split.pre_tokenize_str(plain) for i in range(start, end))
                sound = sound and not held and ids(text) == ids(a) + ids(b)
        if not sound:
            raise ValueError(f"{path}: the tokenizer keeps white space or looks across it, which encoding word by word does not allow")

    def _forget(self) -> None:
        """Number of each word; the ids of all words in a row, where each word's begin, and whether it was met since it was learned."""
        self.numbers: dict[bytes, int] = {}
        self.word_bytes = 0
        self.ids, self.begins, self.again = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)

    def _forget_rare(self) -> None:
        """Keep the words that were met again, if they fill at most half of what may be remembered.  They have to be met anew to stay longer."""
        kept = [(word, number) for word, number in self.numbers.items() if self.again[number]]
        size = sum(len(word) for word, _ in kept)
        if 2 * len(kept) > self.most_words or 2 * size > MOST_WORD_BYTES:
            kept, size = [], 0
        ids, at = self._spelled(np.fromiter((number for _, number in kept), np.int64, len(kept)))
        self._forget()
        self.ids, self.begins = _room(self.ids, len(ids)), _room(self.begins, len(at))
        self.again = _room(self.again, len(kept))
        self.ids[: len(ids)], self.begins[: len(at)] = ids, at
        self.numbers = {word: number for number, (word, _) in enumerate(kept)}
        self.word_bytes = size

    def rest(self) -> None:
        """At the end of a task: near copies came to it together, so other tasks hardly meet its chunks."""
        self.chunks, self.chunk_bytes = {}, 0

    def _learn(self, words: set[bytes]) -> None:
        # A set less a dictionary's keys would go through all of these.
        new = [word for word in words if word not in self.numbers]
        self.again[[self.numbers[word] for word in words if word in self.numbers]] = True
        if not new:
            return
        codes = [c.ids for c in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in new], add_special_tokens=False)]
        known, ends = len(self.numbers), self.begins[len(self.numbers)] + np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))
        self.ids, self.begins = _room(self.ids, int(ends[-1])), _room(self.begins, known + len(new) + 1)
        self.again = _room(self.again, known + len(new))
        self.ids[self.begins[known] : ends[-1]] = np.fromiter(chain.from_iterable(codes), np.int32)
        self.begins[known + 1 : known + 1 + len(new)] = ends
        self.numbers.update(zip(new, range(known, known + len(new)), strict=True))
        self.word_bytes += sum(map(len, new))

    def _spelled(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of these numbers in a row, and where each word's begin."""
        begins = self.begins[numbers]
        counts = self.begins[numbers + 1] - begins
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.arange(at[-1]) + np.repeat(begins - at[:-1], counts)], at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        raw = data.tobytes()
        cuts, _ = chunk_cuts(data, offsets)
        if len(self.numbers) > self.most_words or self.word_bytes > MOST_WORD_BYTES:
            self._forget_rare()
        if self.chunk_bytes > MOST_CHUNK_BYTES:
            self.chunks, self.chunk_bytes = {}, 0
        pieces = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        fresh = {p: self._split(p) for p in set(pieces) if p not in self.chunks}
        ends = {p: (head, tail) for p, (head, _, tail) in fresh.items()}
        first = np.searchsorted(cuts[:-1], offsets).tolist()
        plans = [self._joins(pieces[a:b], ends) for a, b in zip(first[:-1], first[1:], strict=True)]
        # One call for all words that are new in this slice, those at joins included.
        words = set(chain.from_iterable(inner for _, inner, _ in fresh.values()))
        words.update(word for plan in plans for word, _ in plan if word)
        self._learn(words)
        inner = list(chain.from_iterable(inner for _, inner, _ in fresh.values()))
        ids, at = self._spelled(np.fromiter(map(self.numbers.__getitem__, inner), np.int64, len(inner)))
        upto = at[np.cumsum([0, *(len(inner) for _, inner, _ in fresh.values())])].tolist()
        for (piece, (head, _, tail)), a, b in zip(fresh.items(), upto[:-1], upto[1:], strict=True):
            self.chunks[piece] = head, ids[a:b], tail
            self.chunk_bytes += len(piece) + 4 * (b - a)

        parts, ends_at = [np.zeros(0, np.int32)], [0]
        for plan in plans:
            n = 0
            for word, piece in plan:
                if word:
                    number = self.numbers[word]
                    parts.append(self.ids[self.begins[number] : self.begins[number + 1]])
                    n += len(parts[-1])
                if piece is not None:
                    parts.append(self.chunks[piece][1])
                    n += len(parts[-1])
            ends_at.append(ends_at[-1] + n)
        return np.concatenate(parts), np.array(ends_at, np.int64)

    @staticmethod
    def _split(piece: bytes) -> tuple[bytes, list[bytes], bytes | None]:
        """The chunk's first bytes up to white space, its whole words, its last bytes; the last is None without any."""
        inner = piece.split()
        open_ = not SPACE[piece[0]]
        if open_ and len(inner) == 1 and not SPACE[piece[-1]]:
            return piece, [], None
        head = inner.pop(0) if open_ else b""
        tail = inner.pop() if not SPACE[piece[-1]] else b""
        return head, inner, tail

    def _joins(self, pieces: list[bytes], ends: dict[bytes, tuple]) -> list[tuple[bytes, bytes | None]]:
        """What a text is made of: the word at a join (may be empty), then a chunk's whole words, and so on."""
        plan: list[tuple[bytes, bytes | None]] = []
        ragged = b""
        for piece in pieces:
            held = ends.get(piece)
            head, tail = held if held is not None else self.chunks[piece][::2]
            if tail is None:
                ragged += head
                continue
            plan.append((ragged + head, piece))
            ragged = tail
        if ragged:
            plan.append((ragged, None))
        return plan

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def _encoder(path: str, most_words: int) -> ChunkEncoder:
    """One for each Python worker: the tokenizer and its words serve the worker's later tasks too, within the same bounds."""
    # A task has one core; threads of the library's own would only wait for it.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, most_words)


def _coded(docs: DataFrame, path: str, keep: list[str], decoded: bool, most_words: int = MOST_WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``ids`` and, if asked for, ``decoded``; texts pass Python once."""
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    made = ", ".join([f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep] + ["ids array<int>"] + ["decoded string"] * decoded)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, most_words)
        try:
            with np.errstate(over="ignore"):
                for batch in batches:
                    for piece in slices(batch):
                        ids, at = encoder.encode(*flat(piece.column("text")))
                        new = [list_array(ids, at, pa.int32())]
                        if decoded:
                            new.append(pa.array([encoder.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()))
                        names = ["ids", "decoded"][: len(new)]
                        yield pa.RecordBatch.from_arrays([*(piece.column(name) for name in keep), *new], [*keep, *names])
        finally:
            encoder.rest()

    placed = docs.mapInArrow(_place, f"{fields}, _place long").hint("rebalance", "_place").drop("_place")
    return placed.mapInArrow(encode, made)


def bpe_encode(docs: DataFrame, path: str, most_words: int = MOST_WORDS) -> DataFrame:
    """``docs`` with ``ids``: the token ids of the whole text, as the tokenizers library gives them without special tokens.

    ``most_words`` is how many words a worker remembers; fewer take less memory, there and beside later stages, and more time.

    A null text is empty and has no ids; each row is encoded, also repeated ones and those without an id.  ``docs`` must
    have a column ``text`` and no column ``ids`` or ``_place``; other columns stay as they are.
    """
    return _coded(docs, path, docs.columns, decoded=False, most_words=most_words)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: what the library decodes from ``ids``, special tokens kept; null ids give ''."""
    small_batches(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, MOST_WORDS)
        for batch in batches:
            for at in range(0, len(batch), 100):
                piece = batch.slice(at, 100)
                texts = [encoder.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in piece.column("ids")]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*piece.schema.names, "decoded"])

    return encoded.mapInArrow(decode, f"{fields}, decoded string")


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` without its text, with what ``bpe_encode`` and ``bpe_decode`` give: one pass, in one worker for each task.

    Null texts, repeated rows and names as for ``bpe_encode``; ``docs`` must have no column ``decoded`` either.
    """
    return _coded(docs, path, [name for name in docs.columns if name != "text"], decoded=True)


def bpe_digest(decoded: DataFrame) -> DataFrame:
    """Number of tokens and digests of ids and decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
