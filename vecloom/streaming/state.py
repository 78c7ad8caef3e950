"""Running migration state from a stream of events, whatever order they arrive in.

The state lives in Spark's state store, under the query's checkpoint: for every collection the events that decide its state, and
all additions of write targets that the base known so far has not ruled out.  A base that arrives late may still let some of
them in and others not, so none of these is dropped for another of the same target.  What is kept of two parts of a log, put
together and cut down again, is what is kept of the whole, so neither the order nor the cut into batches matters, and an event
that comes twice counts once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from vecloom.operators.migration import BASES, EVENT_SCHEMA, ORIGINS, compact, current_state
from vecloom.session import ship_package

# A busy collection's events are dealt over this many keys of the store, so that it is not a single task's work.
SHARDS = 8
# Events a task has of a busy collection, more than; and events that a task holds at a time, about.
BUSY = 64
PACKED_ROWS = 100_000
_COLUMNS = [field.split(" ")[0] for field in EVENT_SCHEMA.split(", ")]
_NAMES = [name for name in _COLUMNS if name != "logical_name"]


def deciding(rows: Iterable[tuple]) -> list[tuple]:
    """The rows (fields of the event table without the name) that ``compact`` keeps, for one key of the store."""
    found = {row[0]: dict(zip(_NAMES, row)) for row in rows}

    def pick(test: Callable[[dict], object], choose=max) -> list[int]:
        ids = [event_id for event_id, row in found.items() if test(row)]
        return [choose(ids)] if ids else []

    base = pick(lambda r: r["event"] in BASES)
    keep = {
        *pick(lambda r: True), *base,
        *pick(lambda r: r["event"] in ORIGINS and (r["rollback_target"] is not None or r["read_target"] is not None), min),
        *pick(lambda r: r["task_id"] is not None), *pick(lambda r: r["event"] == "verify"), *pick(lambda r: r["event"] == "cutover"),
        *(i for i, r in found.items() if r["event"] == "dual_write" and r["next_target"] is not None and (not base or i > base[0])),
    }
    return [tuple(found[event_id].values()) for event_id in sorted(keep)]


def _packed(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's events leave of each collection, as one row for each key of the store: a key costs far more than a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys: dict[tuple[str, int], list[tuple]] = {}
            for name, rows in held.items():
                kept = deciding(rows)
                # Only a busy collection is dealt over its keys; what each of them holds is put together when it is read.
                for row in kept:
                    keys.setdefault((name, row[0] % shards if len(kept) > BUSY else 0), []).append(row)
            names, numbers = [name for name, _ in keys], [shard for _, shard in keys]
            parts = pa.array([pickle.dumps(rows) for rows in keys.values()], pa.binary())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(numbers, pa.int32()), parts], ["logical_name", "shard", "part"])

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in _NAMES]
            targets = _NAMES.index("write_targets")
            columns[targets] = [None if value is None else [str(v) for v in value] for value in columns[targets]]
            for name, row in zip(batch.column("logical_name").to_pylist(), zip(*columns)):
                held.setdefault(name, []).append(row)
            size += len(batch)
            if size > PACKED_ROWS:
                yield from out()
                held, size = {}, 0
        yield from out()

    return pack


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    kept = [tuple(row) for row in state.get[0]] if state.exists else []
    for batch in batches:
        kept = deciding(chain(kept, *map(pickle.loads, batch["part"])))
    state.update((kept,))
    yield pd.DataFrame({"logical_name": [key[0]], "shard": [key[1]], "kept": [len(kept)]})


def state_stream(
    events: DataFrame, checkpoint: str, *, shards: int = SHARDS, on_batch: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Fold a stream of events into the state store, until the input is used up.

    Events without an id or a collection are no events.  ``on_batch`` gets the keys a micro-batch has changed and how many events each
    holds; a batch that failed or is run again leaves the store as one run would.
    """
    ship_package(events.sparkSession)
    known = events.select(*_COLUMNS).where("event_id is not null and logical_name is not null")
    fields = [field for field in known.schema if field.name != "logical_name"]
    store = T.StructType([T.StructField("kept", T.ArrayType(T.StructType(fields)))])
    packed = known.mapInArrow(_packed(shards), "logical_name string, shard int, part binary")
    changed = packed.groupBy("logical_name", "shard").applyInPandasWithState(
        _fold, "logical_name string, shard int, kept int", store, "update", GroupStateTimeout.NoTimeout
    )
    out = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (out.foreachBatch(on_batch) if on_batch else out.format("noop")).start()


def kept_events(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """What the store holds after a finished batch (the newest unless one is named), as rows of the event table."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    held = reader.load(checkpoint)
    row = F.explode("value.groupState.kept").alias("r")
    return held.select(F.col("key.logical_name").alias("logical_name"), row).select("logical_name", "r.*").select(
        *_COLUMNS
    )


def latest_state(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """State of every collection after a finished batch (the newest unless one is named)."""
    return current_state(compact(kept_events(spark, checkpoint, batch_id)))
