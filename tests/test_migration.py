import random

import pytest
from pyspark.sql import functions as F

from vecloom.operators import migration as m
from vecloom.sources.events import append_events, append_new, read_events
from vecloom.spec import LogicalSpec


pytestmark = pytest.mark.usefixtures("many_chunks")


def event(i, name, kind, **more):
    row = dict.fromkeys(
        ["read_target", "write_targets", "next_target", "rollback_target", "task_id", "note", "result"]
    )
    row.update(event_id=i, logical_name=name, event=kind, state=m.STATE_AFTER[kind], metadata="{}", created_at=f"t{i:05d}")
    row.update(more)
    return row


def frame(spark, events):
    names = [f.name for f in spark.createDataFrame([], m.EVENT_SCHEMA).schema]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in events], m.EVENT_SCHEMA)


def boot(i, name, target, kind="bootstrap", writes=None, rollback=None):
    return event(i, name, kind, read_target=target, write_targets=writes or [target], rollback_target=rollback or target)


def replay(events):
    """One event after the other, as a mutable row would change."""
    s = {}
    for e in events:
        kind = e["event"]
        s["state"] = e["state"]
        if kind in ("bootstrap", "bootstrap_sync"):
            s["read"], s["writes"] = e["read_target"], list(e["write_targets"])
            s["rollback"] = s.get("rollback") or e["rollback_target"] or e["read_target"]
        elif kind == "dual_write":
            s["writes"] = list(dict.fromkeys([*s["writes"], e["next_target"]]))
        elif kind == "cutover":
            s["read"], s["writes"], s["cutover_at"] = e["next_target"], [e["next_target"]], e["created_at"]
        elif kind == "rollback":
            s["read"], s["writes"] = s["rollback"], [s["rollback"]]
        elif kind == "verify":
            s["verify_at"], s["verify"] = e["created_at"], e["result"] or "pending"
        s["task"] = e["task_id"] or s.get("task")
        s["note"] = e["note"]
    return s


def random_log(seed, names, length):
    rng, out, i = random.Random(seed), [], 0
    for n in range(names):
        name = f"c{n}"
        out.append(boot(i, name, f"{name}_v1", writes=[f"{name}_v1", "shared"]))
        i += 1
        # The first collection owns most of the log.
        for _ in range(length * 5 if n == 0 else rng.randrange(length)):
            kind = rng.choice(["prepare", "dual_write", "backfill", "verify", "cutover", "rollback", "bootstrap_sync"])
            if kind == "bootstrap_sync":
                e = boot(i, name, rng.choice(["x", "y"]), kind, writes=["x", "v2"])
            else:
                nxt = rng.choice(["v2", "v3", "shared"]) if kind in ("prepare", "dual_write", "cutover") else None
                e = event(i, name, kind, next_target=nxt, result=rng.choice([None, "ok"]) if kind == "verify" else None)
            e["task_id"] = rng.choice([None, f"t{i}"]) if kind in ("prepare", "dual_write", "backfill") else None
            e["note"] = rng.choice([None, f"n{i}"])
            out.append(e)
            i += 1
    return out


def check_states(states, log):
    for r in states.collect():
        want = replay([e for e in log if e["logical_name"] == r.logical_name])
        assert (r.state, r.read_target, r.write_targets, r.rollback_target, r.task_id, r.note) == (
            want["state"], want["read"], want["writes"], want["rollback"], want["task"], want["note"]
        ), r.logical_name
        assert (r.last_verify_at, r.last_verify_result, r.last_cutover_at) == (
            want.get("verify_at"), want.get("verify"), want.get("cutover_at")
        )


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_replay(spark, seed):
    log = random_log(seed, 40, 12)
    states = m.current_state(frame(spark, log))
    assert states.count() == 40
    check_states(states, log)


def test_compaction_in_steps(spark):
    log = random_log(9, 20, 12)
    compacted = frame(spark, [])
    for start in range(0, len(log), 60):
        compacted = m.compact(compacted.unionByName(frame(spark, log[start : start + 60]))).checkpoint()
    assert compacted.count() < len(log)
    check_states(m.current_state(compacted), log)


def test_as_of_equals_replay(spark):
    log = random_log(4, 8, 12)
    asks = [(e["logical_name"], e["event_id"], q) for e in log for q in range(2)]
    requests = spark.createDataFrame(asks, "logical_name string, at bigint, q int")
    got = m.routing_as_of(requests, frame(spark, log)).collect()
    assert len(got) == len(asks)
    for r in got:
        want = replay([e for e in log if e["logical_name"] == r.logical_name and e["event_id"] <= r.at])
        assert (r.state, r.read_target, r.write_targets) == (want["state"], want["read"], want["writes"]), (r.logical_name, r.at)


def test_cutover_and_rollback(spark):
    log = [boot(0, "k", "v2"), event(1, "k", "prepare", next_target="v3"), event(2, "k", "dual_write", next_target="v3"), event(3, "k", "backfill"),
           event(4, "k", "verify", result="ok"), event(5, "k", "cutover", next_target="v3")]
    live = m.current_state(frame(spark, log)).head()
    assert (live.state, live.read_target, live.write_targets, live.rollback_target) == ("live", "v3", ["v3"], "v2")
    back = m.current_state(frame(spark, [*log, event(6, "k", "rollback")])).head()
    assert (back.state, back.read_target, back.write_targets) == ("rollback", "v2", ["v2"])


def test_recent(spark):
    log = frame(spark, random_log(1, 3, 12))
    assert m.recent_events(log, 0).groupBy("logical_name").count().agg(F.max("count")).head()[0] == 1
    newest = m.recent_events(log.filter("logical_name = 'c0'"), 5).orderBy(F.col("event_id").desc()).collect()
    assert len(newest) == 5


def test_phase_events(spark):
    actions = spark.createDataFrame(
        [(1, "a", "prepare", "t1", None, None, None, "x"), (2, "a", "dual-write", None, "n", None, None, "x"), (3, "b", "cutover", None, None, None, None, "x"),
         (4, "a", "verify", "t9", None, None, None, "x"), (5, "zzz", "prepare", None, None, None, None, "x"), (6, "a", "explode", None, None, None, None, "x")],
        "event_id bigint, logical_name string, action string, task_id string, note string, result string, metadata string, created_at string",
    )
    logical = m.logical_table(spark, [LogicalSpec("a", ("v1",), next_target="v2"), LogicalSpec("b", ("v1",))])
    events, rejected = m.phase_events(actions, logical)
    got = {r.event_id: r for r in events.collect()}
    assert set(got) == {1, 2, 4}
    assert got[2].event == "dual_write" and got[2].next_target == "v2" and got[1].task_id == "t1"
    assert got[4].task_id is None and got[4].result == "pending"
    reasons = {r.event_id: r.reason for r in rejected.collect()}
    assert reasons[3] == "Logical collection 'b' has no configured next_target"
    assert "Unknown" in reasons[5] and "Unsupported" in reasons[6]


def test_bootstrap_and_drift(spark, tmp_path):
    path = str(tmp_path / "events")
    logical = m.logical_table(spark, [LogicalSpec("k", ("v2",)), LogicalSpec("w", ("docs",), ("docs", "docs2"))])
    assert read_events(spark, path).count() == 0
    append_new(m.bootstrap_events(logical, m.current_state(read_events(spark, path))), path)
    assert m.bootstrap_events(logical, m.current_state(read_events(spark, path))).count() == 0
    # The stored idle state is moved away from the configuration.
    append_events(frame(spark, [boot(100, "k", "v3", "bootstrap_sync")]), path)
    drift = m.bootstrap_events(logical, m.current_state(read_events(spark, path)))
    assert [(r.logical_name, r.event, r.read_target, r.rollback_target) for r in drift.collect()] == [("k", "bootstrap_sync", "v2", "v2")]
    append_new(drift, path)
    state = {r.logical_name: r for r in m.current_state(read_events(spark, path)).collect()}
    assert state["k"].read_target == "v2" and state["w"].write_targets == ["docs", "docs2"]
    assert read_events(spark, path).agg(F.max("event_id")).head()[0] == 101


def test_resolve(spark):
    log = frame(spark, [boot(0, "k", "v2"), event(1, "e", "bootstrap")])
    logical = m.logical_table(spark, [LogicalSpec("k", ("v2",)), LogicalSpec("e"), LogicalSpec("lost", ("x",))])
    requests = spark.createDataFrame([("k",), ("e",), ("lost",), ("physical",)], "collection string")
    got = {r.collection: r for r in m.resolve_targets(requests, m.current_state(log), logical).collect()}
    assert got["k"].read_target == "v2" and got["k"].reason is None
    assert got["physical"].write_targets == ["physical"]
    assert "no read target" in got["e"].reason and "Unknown" in got["lost"].reason


def test_verify(spark):
    source = spark.createDataFrame([("1", "x", "a"), ("2", "x", "b"), ("3", "y", None)], "id string, part string, text string")
    target = spark.createDataFrame([("1", "x", "a"), ("3", "y", None), ("9", "z", "new")], "id string, part string, text string")
    got = {r.part: (r.source_count, r.target_count, r.missing, r.extra, r.differing, r.result) for r in m.verify_backfill(source, target, "part", ["text"]).collect()}
    assert got == {"x": (2, 1, 1, 0, 0, "mismatch"), "y": (1, 1, 0, 0, 0, "ok"), "z": (0, 1, 0, 1, 0, "mismatch")}


def test_checkpoint(spark):
    log = frame(spark, [event(1, "k", "prepare"), event(2, "k", "backfill", metadata='{"checkpoint": {"last_id": "p-100"}}'), event(3, "k", "backfill")])
    rows = spark.createDataFrame([("p-100",), ("p-101",), ("p-099",)], "id string")
    assert [r.id for r in m.after_checkpoint(rows, log, "k").collect()] == ["p-101"]
    assert m.after_checkpoint(rows, log, "other").count() == 3
