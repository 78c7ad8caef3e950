"""Turning text columns into dense vectors with a pluggable model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.vectors import normalise
from vecloom.session import ship_package
from vecloom.spec import Catalog, Model

# Fixed value: texts per model call.
MODEL_BATCH = 64


class Embedder(Protocol):
    """A model.  Instances are sent to the workers, so load weights in ``load``, not in ``__init__``."""

    vector_size: int

    def load(self, device: str | None) -> None: ...

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A deterministic stand-in for a model: every token adds +1 or -1 to one of ``vector_size`` places.

    The place is the first 32 bits of the token's MD5 modulo the size, the sign the parity of the
    ninth hex digit.
    """

    def __init__(self, vector_size: int = 64):
        self.vector_size = vector_size

    def load(self, device: str | None) -> None:
        size = self.vector_size

        @lru_cache(maxsize=200_000)
        def place(token: str) -> tuple[int, int]:
            digest = hashlib.md5(token.encode("utf-8")).hexdigest()
            return int(digest[:8], 16) % size, 1 - 2 * (int(digest[8], 16) % 2)

        self._place = place

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vector_size))
        for i, text in enumerate(texts):
            places = [self._place(token.lower()) for token in re.findall(r"\w+", text)]
            if places:
                at, sign = zip(*places)
                np.add.at(out[i], list(at), sign)
        return out


def embed_texts(
    df: DataFrame,
    text: str,
    embedder: Embedder,
    *,
    into: str = "vector",
    unit_length: bool = True,
    device: str | None = None,
    batch_size: int = MODEL_BATCH,
    keep: Column | None = None,
) -> DataFrame:
    """Add ``into`` with the vector of ``text``; null texts, and rows where ``keep`` is false, get null.

    Only the texts travel to Python, in Arrow batches; one model per task, no shuffle.  A model that fails on its
    device is loaded again on the cpu and the batch repeated.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder.load(device)
        for batch in batches:
            texts = batch.to_pylist()
            at = [i for i, value in enumerate(texts) if value is not None]
            made = [
                _encode(embedder, [texts[i] for i in at[start : start + batch_size]], device)
                for start in range(0, len(at), batch_size)
            ]
            yield _as_lists(len(texts), at, np.concatenate(made) if made else np.empty((0, 0), dtype=np.float32))

    # Marked so that the optimizer never computes it twice for two uses of the vector.
    model = F.arrow_udf(run, T.ArrayType(T.FloatType(), False)).asNondeterministic()
    wanted = F.col(text) if keep is None else F.when(keep, F.col(text))
    embedded = df.withColumn(into, model(wanted))
    return embedded.withColumn(into, normalise(F.col(into))) if unit_length else embedded


def _as_lists(n: int, at: list[int], matrix: np.ndarray) -> pa.Array:
    """A list column of ``n`` rows with the rows of ``matrix`` at the positions ``at`` and nulls elsewhere."""
    held = np.zeros(n, dtype=bool)
    held[at] = True
    offsets = np.concatenate([[0], np.cumsum(held)]) * matrix.shape[1]
    # A null offset makes a null list.
    starts = pa.array(offsets.astype(np.int32), mask=np.append(~held, False))
    kind = pa.list_(pa.field("element", pa.float32(), nullable=False))
    return pa.ListArray.from_arrays(starts, pa.array(matrix.reshape(-1)), type=kind)


def _encode(embedder: Embedder, texts: list[str], device: str | None) -> np.ndarray:
    try:
        return np.asarray(embedder.encode(texts), dtype=np.float32)
    except Exception:
        if device in (None, "cpu"):
            raise
        embedder.load("cpu")
        return np.asarray(embedder.encode(texts), dtype=np.float32)


def embed_by_model(
    df: DataFrame, text: str, embedders: Mapping[str, Embedder], models: Sequence[Model], *, model: str = "model", into: str = "vector", device: str | None = None
) -> DataFrame:
    """Each row's text by the model its row names (see ``select_models``): adds ``into``, ``vector_size`` and ``reason``.

    Vectors are brought to unit length if their model says so.  A model that is not there, or one whose vectors have another size than it
    declares, gives the reason, and no vector.  Every model sees the texts of its rows only; the number of models is that of the configuration.
    """
    known = {m.name: m for m in models}
    made, found = df, F.lit(None).cast("array<float>")
    for at, (name, embedder) in enumerate(embedders.items()):
        flag = known[name].unit_length if name in known else True
        made = embed_texts(made, text, embedder, into=f"_made{at}", unit_length=flag, device=device, keep=F.col(model) == name)
        found = F.coalesce(found, F.col(f"_made{at}"))
    names = F.coalesce(F.col(model), F.lit(""))
    declared = lookup({m.name: m.size for m in models}, F.col(model)).cast("int")
    made = made.withColumn("_found", found).drop(*[f"_made{at}" for at in range(len(embedders))])
    size = F.when(F.col("_found").isNotNull(), F.size("_found"))
    reason = F.when(~names.isin(*embedders), F.concat(F.lit("Unknown model: "), names)).when(
        size != declared, F.concat(F.lit("Model '"), names, F.lit("' is declared with size "), declared.cast("string"), F.lit(" but gives "), size.cast("string"))
    )
    return made.withColumns({"reason": reason, "vector_size": size.cast("bigint")}).withColumn(into, F.when(F.col("reason").isNull(), F.col("_found"))).drop("_found")


# --- model selection ------------------------------------------------------------------------------------


def resolve_model_name(name: str | None, models: tuple[Model, ...]) -> str | None:
    """A registered name, or that of the model with this implementation, or the name itself."""
    if name is None or any(m.name == name for m in models):
        return name
    return next((m.name for m in models if m.implementation == name), name)


def select_models(requests: DataFrame, catalog: Catalog, purpose: str) -> DataFrame:
    """Add ``model``: for each row's ``collection`` (requested name) and ``physical`` (where it resolves to).

    Order: the request's own ``asked_model``, the logical collection's model for the purpose, the physical collection's
    model for the purpose, its general model, ``default``, the first registered one.
    """
    if purpose not in ("query", "write"):
        raise ValueError("'purpose' must be 'query' or 'write'")

    names = [m.name for m in catalog.models]
    last = "default" if "default" in names else (names[0] if names else catalog.default_model)
    logical = lookup({s.name: s.models.get(purpose) for s in catalog.logical}, F.col("collection"))
    physical = lookup({s.name: s.models.get(purpose) or s.models.get("any") for s in catalog.collections}, F.col("physical"))
    asked = F.col("asked_model") if "asked_model" in requests.columns else F.lit(None).cast("string")
    alias = lookup({m.implementation: m.name for m in reversed(catalog.models)}, asked)
    known = asked.isin(names) if names else F.lit(False)
    own = F.when(known, asked).otherwise(F.coalesce(alias, asked))
    return requests.withColumn("model", F.coalesce(own, logical, physical, F.lit(last)))


def lookup(values: dict[str, object], key: Column) -> Column:
    """Configuration lookup as a literal map; null for unknown keys and null values."""
    present = {k: v for k, v in values.items() if v is not None}
    if not present:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in present.items() for x in pair])
    return F.try_element_at(table, key)
