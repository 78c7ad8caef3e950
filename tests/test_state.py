"""The running state must not depend on how the log is cut, on the order of its parts, or on batches that run twice."""

import itertools
import random

import pytest
from pyspark.errors import StreamingQueryException
from test_migration import boot, event, frame, random_log

from vecloom.operators.migration import compact, current_state
from vecloom.streaming.state import deciding, kept_events, latest_state, state_stream

# A base (4) that comes late lies between two additions of the same target.
LATE_BASE = [
    boot(0, "c", "v1"), event(1, "c", "prepare", next_target="v3"), event(2, "c", "dual_write", next_target="v3"), event(3, "c", "verify"),
    event(4, "c", "rollback"), event(5, "c", "dual_write", next_target="v3"), event(6, "c", "verify", result="ok"),
]


def rows(df):
    return sorted(map(str, df.collect()))


def stream(spark, source, parts, **options):
    for n, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{source}/part={n}")
    reader = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(f"{source}/*")


def test_compact_keeps_what_a_late_base_may_let_in(spark):
    parts = [LATE_BASE[:4], LATE_BASE[5:], LATE_BASE[4:5]]
    wanted = rows(current_state(frame(spark, LATE_BASE)))
    assert "['v1', 'v3']" in wanted[0]
    for order in itertools.permutations(parts):
        held = frame(spark, [])
        for part in order:
            held = compact(held.unionByName(frame(spark, part))).checkpoint()
        assert rows(current_state(held)) == wanted


@pytest.mark.parametrize("seed", range(4))
def test_store_rows_are_those_of_compact(spark, seed):
    log = random_log(seed, 3, 14)
    names = [f.name for f in frame(spark, []).schema if f.name != "logical_name"]
    wanted = {(r["logical_name"], r["event_id"]) for r in compact(frame(spark, log)).collect()}
    for cut in (1, 5, len(log)):
        shuffled = random.Random(cut).sample(log, len(log))
        got = set()
        for name in {e["logical_name"] for e in log}:
            held = []
            own = [tuple(e[n] for n in names) for e in shuffled if e["logical_name"] == name]
            for start in range(0, len(own), cut):
                held = deciding([*held, *own[start : start + cut]])
            got |= {(name, row[0]) for row in held}
        assert got == wanted


@pytest.mark.parametrize("seed, shards", [(0, 1), (1, 3), (2, 8)])
def test_stream_in_any_order(spark, tmp_path, seed, shards):
    rng = random.Random(seed)
    log = [*random_log(6 + seed, 4, 10), *[{**e, "event_id": e["event_id"] + 10_000, "logical_name": "late"} for e in LATE_BASE]]
    dealt = rng.sample(log, len(log))
    parts = [dealt[i::4] for i in range(4)]
    # A part that comes twice, and events that are none.
    parts.append(parts[0])
    parts.append([{**log[0], "event_id": None}, {**log[0], "logical_name": None}])
    query = state_stream(stream(spark, str(tmp_path / "log"), parts), str(tmp_path / "mark"), shards=shards)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 5
    assert rows(latest_state(spark, str(tmp_path / "mark"))) == rows(current_state(frame(spark, log)))


def test_only_a_busy_collection_has_many_keys(spark, tmp_path):
    log = [e for k in range(12) for e in [boot(100 * k, f"c{k}", "v1"), *[event(100 * k + i, f"c{k}", "verify") for i in range(1, 40)]]]
    log += [boot(9000, "busy", "v1"), *[event(9000 + i, "busy", "dual_write", next_target=f"v{i % 5}") for i in range(1, 600)]]
    seen = []
    parts = [log[::2], log[1::2]]
    query = state_stream(stream(spark, str(tmp_path / "log"), parts), str(tmp_path / "mark"), on_batch=lambda changed, n: seen.append(changed.collect()))
    query.awaitTermination()
    keys = {(r["logical_name"], r["shard"]) for rows_ in seen for r in rows_}
    assert len([k for k in keys if k[0] != "busy"]) == 12 and len([k for k in keys if k[0] == "busy"]) == 8
    assert rows(latest_state(spark, str(tmp_path / "mark"))) == rows(current_state(frame(spark, log)))


def test_restart_and_replay(spark, tmp_path):
    log = random_log(11, 3, 10)
    parts = [log[20:], log[:10], log[10:20]]
    source, mark = str(tmp_path / "log"), str(tmp_path / "mark")
    seen = []

    def fails_once(changed, batch_id):
        seen.append((batch_id, changed.count()))
        if len(seen) == 2:
            raise RuntimeError("lost")

    query = state_stream(stream(spark, source, parts[:2]), mark, on_batch=fails_once)
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    # The second batch runs again, then a new part comes.
    state_stream(stream(spark, source, []), mark, on_batch=fails_once).awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 1]
    first_two = rows(current_state(frame(spark, parts[0] + parts[1])))
    assert rows(latest_state(spark, mark)) == first_two
    frame(spark, parts[2]).coalesce(1).write.parquet(f"{source}/part=9")
    state_stream(stream(spark, source, []), mark).awaitTermination()
    assert rows(latest_state(spark, mark)) == rows(current_state(frame(spark, log)))
    # Older states can be read as long as the store keeps them.
    assert rows(latest_state(spark, mark, 1)) == first_two
    assert kept_events(spark, mark).count() < len(log) + 1
