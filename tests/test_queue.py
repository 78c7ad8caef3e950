import json

import pytest

from vecloom.operators import queue as q

WINDOW = ("14:00", "15:20", "15:45")
ITEMS = (
    "id string, logical_collection string, task_config string, window struct<start: string, stop_dispatch: string, pause_at: string>,"
    " status string, task_id string, last_error string, created_at string, sequence int"
)
EVENTS = "event_id bigint, logical_name string, task_id string, metadata string"


def items(spark, *rows):
    base = {"logical_collection": "k", "task_config": '{"a": 1}', "window": WINDOW, "status": "queued", "task_id": None, "last_error": None, "created_at": None, "sequence": 0}
    filled = [{**base, **r} for r in rows]
    order = [c.split()[0] for c in "id, logical_collection, task_config, window, status, task_id, last_error, created_at, sequence".split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in filled], ITEMS)


def planned(spark, rows, tasks, now, events=()):
    log = spark.createDataFrame(list(events), EVENTS)
    known = spark.createDataFrame(tasks, "task_id string, status string")
    return q.next_actions(q.reconcile(items(spark, *rows), log, known), now)


def test_starts_due_item(spark):
    r = planned(spark, [{"id": "a"}], [], "14:30").head()
    assert (r.next_action, r.status) == ("start", "queued")
    assert planned(spark, [{"id": "a"}], [], "15:20").head().next_action == "skip"
    assert planned(spark, [{"id": "a", "task_config": None}], [], "14:30").head().next_action == "fail"


def test_pauses_at_the_boundary(spark):
    r = planned(spark, [{"id": "a", "status": "running", "task_id": "job-r"}], [("job-r", "running")], "15:50").head()
    assert r.next_action == "pause"
    assert planned(spark, [{"id": "a", "status": "running", "task_id": "t"}], [("t", "running")], "15:40").head().next_action == "wait"


def test_recovers_task_from_events(spark):
    events = [(1, "k", "job-old", '{"queue_item_id": "a"}'), (2, "k", "job-new", '{"queue_item_id": "a"}'), (3, "k", " ", '{"queue_item_id": "a"}'), (4, "z", "job-z", '{"queue_item_id": "a"}')]
    r = planned(spark, [{"id": "a"}], [("job-new", "completed")], "00:00", events).head()
    assert (r.task_id, r.status, r.last_error) == ("job-new", "completed", None)
    r = planned(spark, [{"id": "a"}], [("job-new", "pending")], "14:30", events).head()
    assert (r.status, r.next_action) == ("pending", "start")


def test_any_event_counts_however_old(spark):
    events = [(1, "k", "old", '{"queue_item_id": "a"}')] + [(i, "k", "t", '{"queue_item_id": "b"}') for i in range(2, 402)]
    r = planned(spark, [{"id": "a"}], [("old", "completed")], "14:30", events).head()
    assert (r.task_id, r.status) == ("old", "completed")
    log = spark.createDataFrame(events, EVENTS)
    assert q.recover_task_ids(items(spark, {"id": "a"}), log, 200).head().task_id is None


@pytest.mark.parametrize(
    ("before", "task", "status", "error", "action"),
    [
        ("running", "paused", "paused", "old", "resume"),
        ("queued", "paused", "queued", "old", "resume"),
        ("", "pending", "queued", "old", "start"),
        ("failed", "running", "running", None, "wait"),
        ("queued", "failed", "failed", "task t failed", "fail"),
        ("queued", "completed", "completed", None, "skip"),
        ("queued", "verifying", "verifying", "old", "none"),
        ("queued", None, "failed", "task t not found", "fail"),
        ("completed", None, "completed", "task t not found", "skip"),
    ],
)
def test_sync(spark, before, task, status, error, action):
    known = [("t", task)] if task else []
    r = planned(spark, [{"id": "a", "status": before, "task_id": "t", "last_error": "old"}], known, "14:30").head()
    assert (r.status, r.last_error, r.next_action) == (status, error, action)


def test_choice(spark):
    rows = [{"id": "late", "sequence": 2}, {"id": "done", "sequence": 0, "task_id": "t"}, {"id": "b", "sequence": 1}, {"id": "a", "sequence": 1, "created_at": "2026"}]
    plan = planned(spark, rows, [("t", "completed")], "14:30")
    assert q.run_choice(plan).head().id == "b"
    rows.append({"id": "busy", "sequence": 9, "status": "running", "task_id": "r"})
    plan = planned(spark, rows, [("t", "completed"), ("r", "running")], "14:30")
    assert tuple(q.run_choice(plan).head()) == ("busy", "wait", "r")
    assert q.run_choice(planned(spark, [{"id": "x"}], [], "12:00")).count() == 0


def test_wrapping_window(spark):
    night = items(spark, {"id": "a", "window": ("23:30", "00:30", "14:30")})
    assert night.filter(q.within_window("23:45")).count() == 0
    assert night.filter(q.within_window("23:45", wrap=True)).count() == 1
    assert night.filter(q.within_window("12:00", wrap=True)).count() == 0


def test_reads_queue_files(spark, tmp_path):
    item = {
        "id": "part-c", "logical_collection": "k", "task_config": {"source": {"collection": "v2"}}, "shards": ["x", "y"],
        "window": {"start": "14:00", "stop_dispatch": "15:20", "pause_at": "15:45"}, "sequence": 30, "unknown": 1,
    }
    path = tmp_path / "queue.json"
    path.write_text(json.dumps({"items": [item, {**item, "id": "part-a", "sequence": 10, "status": "running"}]}, indent=2))
    got = q.in_order(q.read_queue(spark, str(path))).collect()
    assert [r.id for r in got] == ["part-a", "part-c"]
    assert got[1].status == "queued" and got[1].shards == ["x", "y"] and json.loads(got[1].task_config) == item["task_config"]
