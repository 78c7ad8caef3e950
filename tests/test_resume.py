"""Slices that end in any order, and comparison by digests, against plain Python."""

import json
import random

import pytest

from vecloom.operators.digests import compare_tables
from vecloom.operators.migration import EVENT_SCHEMA, verify_backfill
from vecloom.operators.ordering import running_max
from vecloom.operators.resume import finished_slices, open_ranges, open_rows, progress

pytestmark = pytest.mark.usefixtures("many_chunks")


def ident(n):
    return f"{n:04d}"


def random_slices(seed):
    rng, rows = random.Random(seed), []
    for name in ("hot", "b", "whole", None):
        cuts = sorted(rng.sample(range(0, 300), 40 if name == "hot" else 6))
        bounds = [None, *map(ident, cuts)]
        slices = list(zip(bounds, bounds[1:]))
        done = slices if name == "whole" else rng.sample(slices, len(slices) * 2 // 3)
        # Some twice, some that overlap.
        done += rng.sample(done, 2) + [(ident(10), ident(30)), (ident(20), ident(25))]
        rows += [(name, a, z) for a, z in done]
    rng.shuffle(rows)
    return rows


def covered(rows, name, at):
    return any(n == name and (a is None or at > a) and at <= z for n, a, z in rows)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("broadcast_ranges", [10_000, 0])
def test_nothing_lost_and_nothing_twice(spark, seed, broadcast_ranges):
    rows = random_slices(seed)
    ranges = open_ranges(spark.createDataFrame(rows, "logical_name string, after_id string, last_id string"))
    source = [(n, ident(i), i % 7) for n in ("hot", "b", "whole", "untouched", None) for i in range(320)]
    table = spark.createDataFrame(source, "logical_name string, id string, payload int").repartition(5)
    got = sorted(map(str, open_rows(table, ranges, table.logical_name, broadcast_ranges=broadcast_ranges).collect()))
    want = [r for r in source if not covered(rows, r[0], r[1])]
    assert got == sorted(str(r) for r in spark.createDataFrame(want, table.schema).collect())
    for r in ranges.collect():
        # No open range holds anything that is covered.
        inside = [i for i in range(320) if (r.after_id is None or ident(i) > r.after_id) and (r.until_id is None or ident(i) <= r.until_id)]
        assert not any(covered(rows, r.logical_name, ident(i)) for i in inside)
    for p in progress(ranges).collect():
        prefix = next((i for i in range(400) if not covered(rows, p.logical_name, ident(i))), 400)
        assert (p.prefix_id is None) == (prefix == 0) and (p.prefix_id is None or p.prefix_id == ident(prefix - 1))


def test_slices_from_events(spark):
    def event(i, slice_):
        return (i, "c", "backfill", "backfill", None, None, None, None, None, None, None, json.dumps({"slice": slice_} if slice_ else {}), "")

    events = [event(1, {"after_id": None, "last_id": "0010"}), event(2, {"after_id": "0020", "last_id": "0030"}), event(3, None),
              event(4, {"after_id": "0030", "last_id": "0030"}), event(5, {"after_id": "0020", "last_id": "0030"})]
    slices = finished_slices(spark.createDataFrame(events, EVENT_SCHEMA))
    assert slices.count() == 2
    got = {(r.after_id, r.until_id) for r in open_ranges(slices).collect()}
    assert got == {("0010", "0020"), ("0030", None)}
    assert tuple(progress(open_ranges(slices)).head()) == ("c", "0010", 1)
    assert open_ranges(slices.where("false")).count() == 0


def test_running_max(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 5 + [None]), i, rng.choice([None, rng.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(4)
    got = {r.i: r.m for r in running_max(df, ["k"], ["i"], "v", "m").collect()}
    for k, i, _ in rows:
        before = [v for kk, ii, v in rows if kk == k and ii < i and v is not None]
        assert got[i] == (max(before) if before else None)


def tables(spark, seed, changes):
    rng = random.Random(seed)
    rows = {f"k{i}": (rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, None])) for i in range(600)}
    other = dict(rows)
    for _ in range(changes):
        at = rng.choice(list(rows))
        kind = rng.randrange(4)
        if kind == 0:
            other.pop(at, None)
        elif kind == 1:
            other[f"new{rng.randrange(1000)}"] = ("c", "x", 1)
        elif kind == 2:
            other[at] = (rows[at][0], None, 5)
        else:
            # Moved to another partition.
            other[at] = ("a" if rows[at][0] != "a" else "b", *rows[at][1:])
    schema = "id string, part string, text string, n int"
    return [spark.createDataFrame([(k, *v) for k, v in t.items()], schema).repartition(n) for t, n in ((rows, 3), (other, 4))], rows, other


@pytest.mark.parametrize("seed, changes, ranges, parts", [(1, 0, 64, 8), (2, 3, 64, 8), (3, 40, 16, 4), (4, 5, 1, 1)])
def test_digests_against_the_full_join(spark, seed, changes, ranges, parts):
    (source, target), rows, other = tables(spark, seed, changes)
    done = compare_tables(source, target, "part", ["text", "n"], ranges=ranges, parts=parts)
    want = verify_backfill(source, target, "part", ["text", "n", "part"])
    assert sorted(map(str, done.report.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    got = {r.id: (r.kind, r.source and tuple(r.source), r.target and tuple(r.target)) for r in done.differences.collect()}
    expected = {}
    for k in rows.keys() | other.keys():
        if rows.get(k) != other.get(k):
            kind = "missing" if k not in other else "extra" if k not in rows else "differing"
            expected[k] = (kind, rows[k][1:] if k in rows else None, other[k][1:] if k in other else None)
    assert got == expected
    if not changes:
        assert done.looked_at == (0, 0)
    elif ranges > 1 and changes < 10:
        assert done.looked_at[0] <= changes and done.looked_at[1] <= changes


def test_no_row_is_shuffled_where_sides_agree(spark, tmp_path):
    (source, _), *_ = tables(spark, 7, 0)
    source.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    done = compare_tables(stored, stored, "part", ["text", "n"])
    plan = done.report._jdf.queryExecution().executedPlan().toString()
    # The report is made of digests; the tables themselves are not in its plan.
    assert f"{tmp_path}/s" not in plan and done.differences.count() == 0
