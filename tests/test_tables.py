import json

import pytest
from pyspark.sql import functions as F

from vecloom.operators import mutate
from vecloom.operators.audit import audit_shapes, collection_stats
from vecloom.operators.embed import HashEmbedder
from vecloom.operators.filters import apply_filter
from vecloom.sources.tables import PointTable, retrieve, scroll, write_all
from vecloom.spec import CollectionSpec, PrefixPart, PrefixPolicy
from vecloom.streaming.ingest import ingest_stream

SPEC = CollectionSpec("kb", 2, vector_name="dense", sparse_vector_name="sparse", payload_types=(("text", "string"), ("lang", "string")), buckets=4)


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, dense array<float>, lang string, n int, score double")


@pytest.fixture
def table(spark, tmp_path):
    t = PointTable(spark, str(tmp_path), SPEC)
    assert t.ensure() is True and t.ensure() is False
    return t


def rows(table):
    return {r.id: r for r in table.read().collect()}


def test_upsert_replaces(spark, table):
    assert table.upsert(batch(spark, [("a", [1.0, 0.0], "en", 1, 0.5), ("b", [0.0, 1.0], "fr", 2, None)])) == 2
    table.upsert(batch(spark, [("b", [0.5, 0.5], "de", 3, None), ("c", [1.0, 1.0], None, None, None)]))
    got = rows(table)
    assert set(got) == {"a", "b", "c"} and got["b"].lang == "de" and got["b"].dense == [0.5, 0.5]
    assert json.loads(got["a"].extra) == {"n": 1, "score": 0.5} and got["c"].extra is None
    again = batch(spark, [("b", [0.5, 0.5], "de", 3, None), ("c", [1.0, 1.0], None, None, None)])
    table.upsert(again)
    assert rows(table) == got


def test_last_in_batch_wins(spark, table):
    many = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("lang")
    ).repartition(7)
    assert table.upsert(many, "ordinal") == 601
    got = rows(table)
    assert len(got) == 601 and got["hot"].lang == "897"


def test_untouched_buckets_stay(spark, table, tmp_path):
    table.upsert(batch(spark, [(str(i), [1.0, 0.0], "en", i, None) for i in range(40)]))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "kb").rglob("*.parquet")}
    table.upsert(batch(spark, [("7", [0.0, 1.0], "fr", 7, None)]))
    table.expire()
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "kb").rglob("*.parquet")}
    same = {f.parent.name for f in before if after.get(f) == before[f]}
    assert len({"bucket=0", "bucket=1", "bucket=2", "bucket=3"} & same) == 3
    assert len(rows(table)) == 40 and rows(table)["7"].lang == "fr"


def test_filters_on_stored_payload(spark, table):
    table.upsert(batch(spark, [("a", [1.0, 0.0], "en", 1, 0.5), ("b", [0.0, 1.0], "en", 2, 0.9)]))
    points = table.read()
    assert [r.id for r in apply_filter(points, {"lang": "en", "n": 2}).collect()] == ["b"]
    assert [r.id for r in apply_filter(points, {"must": [{"key": "score", "range": {"lt": 0.6}}]}).collect()] == ["a"]


def test_json_payload_is_merged(spark, table):
    table.upsert(batch(spark, [("a", [1.0, 0.0], "en", 1, 0.5)]))
    table.upsert(table.read().withColumn("n", F.lit(7)).withColumn("flag", F.lit(True)))
    assert json.loads(rows(table)["a"].extra) == {"n": 7, "score": 0.5, "flag": True}


def test_load_needs_an_empty_table(spark, table):
    table.load(batch(spark, [("a", [1.0, 0.0], "en", 1, 0.5)]))
    with pytest.raises(ValueError):
        table.load(batch(spark, [("b", [1.0, 0.0], "en", 1, 0.5)]))


def test_write_all(spark, tmp_path):
    two = [PointTable(spark, str(tmp_path), SPEC), PointTable(spark, str(tmp_path), CollectionSpec("kb2", 2, buckets=3))]
    for t in two:
        t.ensure()
    assert write_all(batch(spark, [("a", [1.0, 0.0], "en", 1, 0.5)]), two) == {"kb": 1, "kb2": 1}
    assert rows(two[0])["a"].lang == "en" and json.loads(rows(two[1])["a"].extra)["lang"] == "en"


def test_bad_specs(spark, tmp_path):
    for bad in (CollectionSpec("x", 2, distance="hamming"), CollectionSpec("x", 2, sparse_modifier="bm42")):
        with pytest.raises(ValueError):
            PointTable(spark, str(tmp_path), bad).ensure()


def test_pages_and_ids(spark, table):
    table.upsert(batch(spark, [(f"p{i:02d}", [1.0, 0.0], "en", i, None) for i in range(20)]))
    first = scroll(table.read(), None, 7).collect()
    assert [r.id for r in first] == [f"p{i:02d}" for i in range(7)]
    second = scroll(table.read(), None, 7, after_id=first[-1].id, with_payload=False, with_vectors=True)
    assert second.columns == ["id", "dense", "sparse"] and second.head().id == "p07"
    ids = spark.createDataFrame([("p03",), ("p03",), ("nope",)], "id string")
    assert [r.id for r in retrieve(table.read(), ids).collect()] == ["p03"]
    with pytest.raises(ValueError):
        scroll(table.read(), None, 1001)


def test_payload(spark):
    points = spark.createDataFrame([("a", "x", 1), ("b", "y", None)], "id string, s string, n int")
    ids = spark.createDataFrame([("a",), ("a",), ("zz",)], "id string")
    got = {r.id: (r.s, r.n, r.new) for r in mutate.payload_set(points, ids, {"s": None, "new": 5}).collect()}
    assert got == {"a": (None, 1, 5), "b": ("y", None, None)}
    assert tuple(mutate.payload_set_counts(points, ids).head()) == (3, 1)
    with pytest.raises(ValueError):
        mutate.payload_set(points, ids, {})
    patches = spark.createDataFrame([("a", 1, "p", None), ("a", 2, None, 9), ("a", 3, "q", None), ("zz", 1, "r", 1)], "id string, ordinal int, s string, n int")
    got = {r.id: (r.s, r.n) for r in mutate.payload_patch(points, patches, ["s", "n"]).collect()}
    assert got == {"a": ("q", 9), "b": ("y", None)}


def test_chunks(spark):
    chunks = spark.createDataFrame(
        [("k1", "hello world hello", [0.1, 0.2], None, "Alice"), (None, "only text", None, "own words", None), ("bad", " ", None, None, None), ("none", None, None, None, None)],
        "id string, chunk_text string, vector array<float>, text string, who string",
    )
    policy = PrefixPolicy((PrefixPart("who"),))
    points, rejected = mutate.prepare_chunks(chunks, "kb", HashEmbedder(2), policy)
    got = {r.id: r for r in points.collect()}
    assert got["k1"].text == "[Alice]\nhello world hello" and [round(x, 6) for x in got["k1"].dense] == [0.1, 0.2]
    other = got[next(i for i in got if i != "k1")]
    # No prefix was made, so the terms come from the caller's own payload text.
    assert other.text == "own words" and len(other.sparse.indices) == 2 and len(other.dense) == 2
    assert {r.id for r in rejected.collect()} == {"bad", "none"}
    again, _ = mutate.prepare_chunks(chunks, "kb", HashEmbedder(2), policy)
    assert {r.id for r in again.collect()} == set(got)


def test_audit(spark):
    points = spark.createDataFrame([("a", [1.0, 2.0])], "id string, dense array<float>")
    stats = collection_stats(spark, {"kb": points, "kb_empty": points.limit(0), "broken": RuntimeError("gone")})
    got = {r.name: r.status for r in stats.collect()}
    assert got == {"kb": "ok", "kb_empty": "ok", "broken": "error: gone"}
    specs = [CollectionSpec("kb", 3), CollectionSpec("kb_empty", 2, sparse_vector_name="sparse"), CollectionSpec("new", 2)]
    assert {r.name: r.action for r in audit_shapes(spark, specs, stats).collect()} == {"kb": "warn", "kb_empty": "recreate", "new": "create"}


def test_ingest_stream(spark, table, tmp_path):
    schema = "id string, chunk_text string, vector array<float>, lang string, at int"
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        ingest_stream(stream, "kb", [table], HashEmbedder(2), mark, rejected_path=str(tmp_path / "rejected"), ordinal="at").awaitTermination()

    spark.createDataFrame([("a", "one", None, "en", 1), ("a", "two", None, "en", 2), ("bad", " ", None, "en", 1)], schema).write.parquet(source)
    run()
    assert {r.id: r.text for r in table.read().collect()} == {"a": "two"}
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == 1
    spark.createDataFrame([("a", "three", None, "fr", 1), ("b", "four", None, "fr", 1)], schema).write.mode("append").parquet(source)
    run()
    assert {r.id: r.text for r in table.read().collect()} == {"a": "three", "b": "four"}
