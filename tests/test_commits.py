"""Stored tables: a write that fails leaves the table as it was, ids find their buckets, term counts follow the upserts."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vecloom.functions.text import sparse_terms
from vecloom.operators.search import term_statistics
from vecloom.operators.validate import split
from vecloom.operators.migration import current_state
from vecloom.sources.aliases import read_alias, read_aliases, run_phases, set_alias, sync_aliases
from vecloom.sources.commits import CommitLog
from vecloom.sources.events import append_events, read_events
from vecloom.sources.tables import PointTable, fixed_batch, write_all, write_checked
from vecloom.spec import CollectionSpec

SPEC = CollectionSpec("kb", 2, sparse_vector_name="sparse", sparse_modifier="idf", payload_types=(("text", "string"),), buckets=5)


@pytest.fixture
def table(spark, tmp_path):
    t = PointTable(spark, str(tmp_path), SPEC)
    t.ensure()
    return t


def batch(spark, rows):
    return spark.createDataFrame([(i, [1.0, 2.0], text) for i, text in rows], "id string, dense array<float>, text string")


def texts(table):
    return {r["id"]: r["text"] for r in table.read().collect()}


def stats(df):
    return sorted((r["index"], r["df"], r["n"]) for r in df.collect())


def counted(spark, held):
    points = spark.createDataFrame(list(held.items()), "id string, text string").withColumn("sparse", sparse_terms(F.coalesce("text", F.lit(""))))
    return stats(term_statistics(points))


def test_statistics_follow_upserts(spark, table):
    rng = random.Random(5)
    words = "a b c d e f g h i j".split()
    held = {}
    for turn in range(18):
        rows = {f"k{rng.randrange(30)}": rng.choice([None, "", "?!", " ".join(rng.choices(words, k=4))]) for _ in range(rng.randrange(1, 12))}
        table.upsert(batch(spark, list(rows.items())))
        if turn % 6 == 0:
            # The same again changes nothing.
            table.upsert(batch(spark, list(rows.items())))
        held |= rows
    assert texts(table) == held
    assert stats(table.statistics()) == counted(spark, held)
    # Sixteen folders of counts have been folded into one.
    assert len(table._commit()[1]["terms"]) < 16
    before = texts(table), stats(table.statistics())
    assert table.expire() > 0 and table.expire() == 0
    assert (texts(table), stats(table.statistics())) == before


def test_failed_write_changes_nothing(spark, table, monkeypatch):
    table.upsert(batch(spark, [(f"k{i}", "old") for i in range(20)]))
    before = texts(table), stats(table.statistics())
    plan = table.read()

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(CommitLog, "put", lost)
    with pytest.raises(RuntimeError):
        table.upsert(batch(spark, [(f"k{i}", "new words") for i in range(10, 30)]))
    monkeypatch.undo()
    assert (texts(table), stats(table.statistics())) == before
    table.upsert(batch(spark, [(f"k{i}", "new words") for i in range(10, 30)]))
    wanted = {f"k{i}": "old" if i < 10 else "new words" for i in range(30)}
    assert texts(table) == wanted and stats(table.statistics()) == counted(spark, wanted)
    # A reader that began before the write still reads what it saw.
    assert {r["id"]: r["text"] for r in plan.collect()} == before[0]
    table.expire()
    assert texts(table) == wanted


def test_two_writers(spark, table, monkeypatch):
    real = PointTable._save

    def slow(self, df, folder):
        real(self, df, folder)
        monkeypatch.setattr(PointTable, "_save", real)
        PointTable(spark, self.root, SPEC).upsert(batch(spark, [("b", "other")]))

    monkeypatch.setattr(PointTable, "_save", slow)
    with pytest.raises(RuntimeError, match="run the write again"):
        table.upsert(batch(spark, [("a", "mine")]))
    assert texts(table) == {"b": "other"}
    table.upsert(batch(spark, [("a", "mine")]))
    assert texts(table) == {"a": "mine", "b": "other"}


def test_cut_off_commit(spark, table, tmp_path):
    table.upsert(batch(spark, [("a", "x")]))
    number = table.commits.numbers()[0]
    (tmp_path / "kb" / "_commits" / f"{number + 1:010d}.json").write_text('{"buckets"')
    assert texts(table) == {"a": "x"}
    table.upsert(batch(spark, [("a", "y")]))
    assert texts(table) == {"a": "y"} and table.commits.numbers()[0] == number + 2


def test_last_row_wins_without_an_ordinal(spark, table):
    rows = spark.createDataFrame([("a", [float(i), 0.0], str(i)) for i in range(50)], "id string, dense array<float>, text string").repartition(1)
    assert table.upsert(rows.sortWithinPartitions(F.col("text").cast("int"))) == 1
    assert texts(table) == {"a": "49"}


def test_retrieve_reads_few_files(spark, tmp_path):
    table = PointTable(spark, str(tmp_path), CollectionSpec("many", 2, payload_types=(("text", "string"),), buckets=16, files_per_bucket=1))
    table.ensure()
    table.load(batch(spark, [(f"k{i:04d}", f"t{i}") for i in range(3000)]))
    few = spark.createDataFrame([("k0007",), ("k0007",), ("nope",), (None,)], "id string")
    found = table.retrieve(few)
    assert [(r["id"], r["text"]) for r in found.collect()] == [("k0007", "t7")]
    assert len(table.read().inputFiles()) == 16 and len(found.inputFiles()) <= 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(id" in plan or "EqualTo(id" in plan or "or(" in plan.lower()
    many = spark.range(2500).select(F.format_string("k%04d", "id").alias("id"))
    assert table.retrieve(many).count() == 2500
    assert table.retrieve(few.where("false")).count() == 0
    assert table.retrieve(few, with_payload=False, with_vectors=True).columns == ["id", "dense"]


def test_one_vector_for_named_targets(spark, tmp_path):
    tables = [PointTable(spark, str(tmp_path), s) for s in (CollectionSpec("one", 2), CollectionSpec("two", 2, vector_name="vec", sparse_vector_name="words"))]
    for t in tables:
        t.ensure()
    write_all(batch(spark, [("a", "hello world")]), tables)
    got = tables[1].read().head()
    assert got["vec"] == [1.0, 2.0] and len(got["words"]["indices"]) == 2 and "dense" not in (got["extra"] or "")
    named = spark.createDataFrame([("b", [3.0, 4.0], [5.0]), ("c", None, [6.0, 7.0])], "id string, vec array<float>, title array<float>")
    counts, rejected = write_checked(named, tables[1:], vectors=["vec", "title"])
    assert counts == {"two": 1} and [r["id"] for r in rejected.collect()] == ["c"]
    assert {r["id"]: r["vec"] for r in tables[1].read().collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}


def test_rows_one_target_cannot_take_are_written_to_none(spark, tmp_path):
    tables = [PointTable(spark, str(tmp_path), CollectionSpec("small", 2)), PointTable(spark, str(tmp_path), CollectionSpec("large", 3))]
    for t in tables:
        t.ensure()
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0, 2.0, 3.0])], "id string, dense array<float>")
    counts, rejected = write_checked(rows, tables)
    assert counts == {"small": 0, "large": 0}
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {
        "a": "Collection 'large' expects dense vector size 3, got 2",
        "b": "Collection 'small' requires a dense vector payload for upsert",
        "c": "Collection 'small' expects dense vector size 2, got 3",
    }
    assert split(fixed_batch(rows, tables, None), [])[0].count() == 3


def test_shape_and_alias_last(spark, table, tmp_path):
    table.upsert(batch(spark, [("a", "x")]))
    assert table.shape()["distance"] == "Cosine" and table.shape()["sparse_modifier"] == "idf"
    assert read_alias(spark, str(tmp_path), "current") is None
    assert table.repoint("current") and read_alias(spark, str(tmp_path), "current") == "kb"
    assert table.repoint("current") and not table.repoint("kb") and not table.repoint("other", ["other"])
    second = PointTable(spark, str(tmp_path), CollectionSpec("kb2", 2))
    second.ensure()
    assert second.repoint("current") and read_alias(spark, str(tmp_path), "current") == "kb2"
    with pytest.raises(FileNotFoundError):
        PointTable(spark, str(tmp_path), CollectionSpec("absent", 2)).read()


def test_aliases_follow_the_state(spark, tmp_path):
    from test_migration import boot, event, frame

    root, log = str(tmp_path), str(tmp_path / "log")
    append_events(frame(spark, [boot(0, "k", "v1"), boot(1, "other", "o1"), boot(2, "same", "s")]), log)
    aliases = {"k": "k_now", "other": "o_now", "same": "s", "absent": "x"}
    logical = spark.createDataFrame([("k", "v2"), ("other", None)], "logical_name string, next_target string")
    schema = "event_id bigint, logical_name string, action string, task_id string, note string, result string, metadata string, created_at string"

    def act(*actions):
        rows = [(i, name, action, None, None, None, None, "t") for i, (name, action) in enumerate(actions)]
        return run_phases(spark, root, log, spark.createDataFrame(rows, schema), logical, aliases)

    moved, rejected = act(("k", "prepare"), ("k", "dual-write"), ("other", "cutover"))
    assert moved == {"k_now": "v1", "o_now": "o1"} and rejected.count() == 1
    assert act(("k", "cutover"))[0] == {"k_now": "v2"} and read_alias(spark, root, "k_now") == "v2"
    # The event was recorded, the alias not: the next run moves it.
    append_events(frame(spark, [event(900, "k", "rollback")]), log)
    states = current_state(read_events(spark, log))
    assert sync_aliases(spark, root, states, aliases) == {"k_now": "v1"} and sync_aliases(spark, root, states, aliases) == {}
    assert read_alias(spark, root, "s") is None and read_alias(spark, root, "x") is None


def test_many_aliases_move_by_one_commit(spark, tmp_path):
    root = str(tmp_path)
    # A name that has a log of its own, as they used to.
    CommitLog(spark, f"{root}/_aliases/k2_now").put({"table": "old"}, None)
    assert read_alias(spark, root, "k2_now") == "old"
    names = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("logical_name"))
    states = names.withColumn("read_target", F.when(F.col("logical_name") != "k7", F.lit("v1")))
    aliases = names.withColumn("alias", F.concat("logical_name", F.lit("_now")))
    assert sync_aliases(spark, root, states, aliases).count() == 2999
    assert len(CommitLog(spark, f"{root}/_aliases/_commits").numbers()) == 1
    assert sync_aliases(spark, root, states, aliases).isEmpty()
    moved = states.withColumn("read_target", F.when(F.col("logical_name") == "k2", "v2").otherwise(F.col("read_target")))
    assert [tuple(r) for r in sync_aliases(spark, root, moved, aliases).collect()] == [("k2_now", "v2")]
    for n in range(20):
        assert set_alias(spark, root, f"own{n % 3}", f"t{n}")
    held = {r["alias"]: r["table"] for r in read_aliases(spark, root).collect()}
    assert len(held) == 3002 and held["k2_now"] == "v2" and held["k3_now"] == "v1" and "k7_now" not in held
    assert [held[f"own{n}"] for n in range(3)] == ["t18", "t19", "t17"]


def test_aliases_set_at_the_same_time(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    set_alias(spark, root, "a", "t1")
    put, others = CommitLog.put, [("b", "t2"), ("a", "t3")]

    def late(log, content, after):
        if others:
            set_alias_first = others.pop(0)
            monkeypatch.setattr(CommitLog, "put", put)
            set_alias(spark, root, *set_alias_first)
            monkeypatch.setattr(CommitLog, "put", late)
        return put(log, content, after)

    monkeypatch.setattr(CommitLog, "put", late)
    # Another alias is set in between, which is no conflict; then this very one.
    with pytest.raises(RuntimeError, match="has changed"):
        set_alias(spark, root, "a", "t4")
    others.clear()
    assert read_alias(spark, root, "a") == "t3" and read_alias(spark, root, "b") == "t2"
    others.append(("c", "t5"))
    assert set_alias(spark, root, "a", "t6") and read_alias(spark, root, "a") == "t6" and read_alias(spark, root, "c") == "t5"


def test_a_large_bucket_is_written_in_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vecloom.sources.tables.PIECE_BYTES", 8000, raising=False)
    table = PointTable(spark, str(tmp_path), CollectionSpec("kb", 2, payload_types=(("text", "string"),), buckets=2))
    table.ensure()
    # As many tasks as pieces, and an id twice.
    rows = spark.range(1500).select((F.col("id") % 1499).cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.col("id").alias("n"))
    assert table.upsert(rows, "n") == 1499
    files = table.read().groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()
    assert len(files) > 4 and max(r["n"] for r in files) < 350
    assert table.upsert(rows.limit(0).select("id", "text").unionByName(spark.createDataFrame([("7", "new"), ("x", "new")], "id string, text string"))) == 2
    after = table.read()
    assert after.count() == after.select("id").distinct().count() == 1500 and after.filter("text = 'new'").count() == 2
    assert after.filter("id = '0'").head()["text"] == rows.filter("n = 1499").head()["text"]


def in_scratch(spark):
    from vecloom.session import scratch_root

    folder = Path(scratch_root(spark).removeprefix("file:"))
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_upsert_shuffles_only_its_own_rows_and_leaves_no_batch(spark, table, tmp_path, monkeypatch):
    table.upsert(batch(spark, [(f"k{i}", "old words") for i in range(200)]))
    real, plans, before = PointTable._save, [], in_scratch(spark)

    def seen(self, df, folder):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        real(self, df, folder)

    monkeypatch.setattr(PointTable, "_save", seen)
    assert table.upsert(batch(spark, [(f"k{i}", "new") for i in range(150, 250)] + [(None, "none")])) == 101
    # What the new rows replace is left out of the old files where it stands.
    assert "Exchange hashpartitioning" not in plans[-1] and "REPARTITION" not in plans[-1] and "old words" not in texts(table)["k150"]
    assert write_all(batch(spark, [(None, "again"), ("k7", "two"), ("k7", "three")]), [table]) == {"kb": 2}
    assert in_scratch(spark) == before
    held = {f"k{i}": "old words" if i < 150 else "new" for i in range(250)} | {None: "again", "k7": "three"}
    assert texts(table) == held and table.read().count() == 251 and stats(table.statistics()) == counted(spark, held)


def test_shuffle_files_go_with_the_write(spark, table):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name.split("_")[1] for name in manager.getAllBlocks().mkString(" ").split() if name.startswith("shuffle")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key, None), shuffles()
    for _ in range(2):
        table.upsert(batch(spark, [(f"k{i}", "some words") for i in range(200)]))
    # What stays is the count of rows by bucket of each upsert, until the driver collects its garbage.
    until = time.monotonic() + 20
    while len(shuffles() - before) > 2 and time.monotonic() < until:
        time.sleep(0.5)
    assert len(shuffles() - before) <= 2 and spark.conf.get(key, None) == setting


def test_many_rows_in_a_file(spark, tmp_path):
    table = PointTable(spark, str(tmp_path), CollectionSpec("one", 2, payload_types=(("n", "bigint"),), buckets=1, files_per_bucket=1))
    table.ensure()
    table.load(spark.range(100_000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("n")))
    # One partition, in which every id comes twice, its larger ordinal at times first.
    new = spark.range(0, 80_000, 1, 1).select(
        (F.col("id") % 40_000 * 3).cast("string").alias("id"), F.col("id").alias("n"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("at")
    )
    assert table.upsert(new, "at") == 40_000
    best = {r["id"]: r["n"] for r in new.groupBy("id").agg(F.max_by("n", "at").alias("n")).collect()}
    got = {r["id"]: r["n"] for r in table.read().collect()}
    assert len(got) == table.read().count() == 100_000 + 40_000 - 33_334
    assert all(n == best.get(i, 0) for i, n in got.items())


def test_files_of_a_bucket_stay_few(spark, tmp_path):
    table = PointTable(spark, str(tmp_path), CollectionSpec("kb", 2, payload_types=(("text", "string"),), buckets=2))
    table.ensure()
    for turn in range(12):
        table.upsert(batch(spark, [(f"k{turn}-{i}", str(turn)) for i in range(20)] + [("k", str(turn))]))
        assert len(table.read().inputFiles()) <= 16
    assert texts(table)["k"] == "11" and table.read().count() == 241


def test_a_large_batch_is_shuffled_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vecloom.sources.tables.PART_BYTES", 2000, raising=False)
    real, sizes = PointTable._save, []
    monkeypatch.setattr(PointTable, "_save", lambda self, df, folder: (sizes.append(df.count()), real(self, df, folder)))
    tables = [PointTable(spark, str(tmp_path), CollectionSpec(name, 2, payload_types=(("text", "string"),), buckets=b)) for name, b in (("a", 1), ("b", 5))]
    for t in tables:
        t.ensure()
    rows = [(f"k{i % 900}", str(i)) for i in range(1000)]
    assert write_all(batch(spark, rows), tables) == {"a": 900, "b": 900}
    assert len(sizes) > 2 and max(sizes) < 900 and sum(sizes) == 1800
    assert texts(tables[0]) == texts(tables[1]) == dict(rows)


def test_ids_that_were_loaded_twice(spark, tmp_path):
    table = PointTable(spark, str(tmp_path), CollectionSpec("kb", 2, payload_types=(("text", "string"),), buckets=1))
    table.ensure()
    table.load(batch(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "x")]))
    table.set_payload(spark.createDataFrame([("a",)], "id string"), {"text": "set"})
    assert table.read().count() == 3 and texts(table) == {"a": "set", "b": "x", "c": "x"}
