"""Scores of close vectors and small weights, prefixes from JSON payload, models by row, payload of stored tables."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from vecloom.functions.prefix import render
from vecloom.operators.embed import HashEmbedder, embed_by_model
from vecloom.operators.mutate import payload_patch
from vecloom.operators.scoring import SparseBlock
from vecloom.operators.search import dense_search, sparse_search
from vecloom.sources.tables import PointTable, patch_payload_all, set_payload_all
from vecloom.spec import CollectionSpec, Model, PrefixPart, PrefixPolicy


@pytest.mark.parametrize("apart", [0.0, 1e-6, 1e-4, 0.01, 3.0])
def test_euclid_of_close_vectors(spark, apart):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 50, 64)
    step = np.zeros(64)
    step[3] = apart
    points = spark.createDataFrame([("p", (base + step).tolist()), ("far", (-base).tolist())], "id string, dense array<double>")
    queries = spark.createDataFrame([("q", base.tolist())], "query_id string, vector array<double>")
    got = {r.id: r.score for r in dense_search(queries, points, 2, metric="euclid").collect()}
    assert got["p"] == pytest.approx(apart, abs=6e-7) and got["far"] == pytest.approx(2 * np.linalg.norm(base), abs=1e-6)


def test_sparse_weights_are_not_rounded(spark):
    kind = "struct<indices: array<int>, values: array<double>>"
    points = spark.createDataFrame([("a", ([1, 2], [1e6, 0.5])), ("b", ([1], [4e-7])), ("c", ([2, 5], [0.123456, 3.0]))], f"id string, sparse {kind}")
    queries = spark.createDataFrame([("tiny", ([1], [4e-7])), ("mix", ([1, 2, 5], [1e6, 0.25, 1 / 3]))], f"query_id string, sparse {kind}")
    got = {(r.query_id, r.id): r.score for r in sparse_search(queries, points, 5).collect()}
    assert got[("tiny", "a")] == pytest.approx(0.4) and got[("tiny", "b")] == 0.0
    assert got[("mix", "b")] == pytest.approx(0.4) and got[("mix", "c")] == pytest.approx(0.25 * 0.123456 + 1.0, abs=1e-6)


def test_sparse_sums_do_not_depend_on_the_batch(spark):
    rng = random.Random(4)
    kind = "struct<indices: array<int>, values: array<double>>"
    rows = [(f"p{i}", (sorted(rng.sample(range(30), 6)), [rng.choice([rng.random(), round(rng.random(), 6)]) for _ in range(6)])) for i in range(200)]
    query = [("q", (list(range(30)), [round(rng.random(), 6) if i % 3 else rng.random() for i in range(30)]))]
    queries = spark.createDataFrame(query, f"query_id string, sparse {kind}")
    points = spark.createDataFrame(rows, f"id string, sparse {kind}")
    one = sorted(map(str, sparse_search(queries, points.repartition(1), 200).collect()))
    assert one == sorted(map(str, sparse_search(queries, points.repartition(60), 200).collect()))
    weights = dict(zip(*query[0][1]))
    got = {r.id: r.score for r in sparse_search(queries, points, 200).collect()}
    for name, (indices, values) in rows:
        assert got[name] == pytest.approx(math.fsum(weights[i] * v for i, v in zip(indices, values)), abs=6e-7)


def test_prefix_of_json_payload(spark):
    extra = {"team": " red ", "size": 3, "ratio": 0.5, "open": True, "tags": ["x", 1, ["y", None], {"k": 1}], "none": None, "obj": {"a": 1}, "blank": " "}
    points = spark.createDataFrame([("a", json.dumps(extra), None), ("b", None, "own")], "id string, extra string, name string")
    keys = ["name", *extra, "absent"]
    policy = PrefixPolicy(tuple(PrefixPart(k, k) for k in keys))
    got = {r.id: r.p for r in points.select("id", render(policy, points.schema).alias("p")).collect()}
    assert got == {"a": "[team: red | size: 3 | ratio: 0.5 | open: True | tags: x, 1, y]", "b": "[name: own]"}


def test_models_by_row(spark):
    texts = spark.createDataFrame([("a", "one two", "raw"), ("b", "one two", "unit"), ("c", "x", "gone"), ("d", None, "raw"), ("e", "y", "lying"), ("f", "z", None)], "id string, text string, model string")
    embedders = {"raw": HashEmbedder(4), "unit": HashEmbedder(8), "lying": HashEmbedder(2)}
    models = [Model("raw", "r", 4, unit_length=False), Model("unit", "u", 8), Model("lying", "l", 5)]
    got = {r.id: r for r in embed_by_model(texts, "text", embedders, models).collect()}
    assert got["a"].vector_size == 4 and sorted(map(abs, got["a"].vector))[-1] >= 1.0
    assert got["b"].vector_size == 8 and np.linalg.norm(got["b"].vector) == pytest.approx(1.0)
    assert got["c"].reason == "Unknown model: gone" and got["c"].vector is None
    assert got["d"].vector is None and got["d"].reason is None
    assert "declared with size 5 but gives 2" in got["e"].reason and got["e"].vector is None
    assert got["f"].reason == "Unknown model: "


def test_patch_clears(spark):
    points = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, s string, n int")
    patches = spark.createDataFrame(
        [("a", 1, "p", 5, None), ("a", 2, None, None, ["s"]), ("b", 1, None, None, ["n"]), ("b", 2, None, 7, None)], "id string, ordinal int, s string, n int, clear array<string>"
    )
    assert {r.id: (r.s, r.n) for r in payload_patch(points, patches, ["s", "n"], clear="clear").collect()} == {"a": (None, 5), "b": ("y", 7)}


def test_payload_of_stored_tables(spark, tmp_path):
    tables = [PointTable(spark, str(tmp_path), CollectionSpec(n, 2, payload_types=p, buckets=3)) for n, p in (("one", (("lang", "string"),)), ("two", ()))]
    rows = spark.createDataFrame([(f"k{i}", [1.0, float(i)], "en", i) for i in range(9)], "id string, dense array<float>, lang string, place int")
    for t in tables:
        t.ensure()
        t.upsert(rows)
    ids = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("nope",), (None,)], "id string")
    assert set_payload_all(tables, ids, {"lang": "fr", "seen": True, "none": None}) == {"one": 2, "two": 2}
    patches = spark.createDataFrame([("k1", 1, "de", 50, None), ("k1", 2, None, None, ["place"]), ("k8", 1, None, 80, None), ("zz", 1, "x", 1, None)], "id string, ordinal int, lang string, place int, gone array<string>")
    assert patch_payload_all(tables, patches, ["lang", "place"], clear="gone") == {"one": 2, "two": 2}
    with pytest.raises(ValueError):
        tables[0].set_payload(ids, {})

    def state(t):
        out = {}
        for r in t.read().collect():
            payload = json.loads(r["extra"] or "{}") | ({"lang": r["lang"]} if t.spec.name == "one" else {})
            out[r["id"]] = (r["dense"], {k: v for k, v in payload.items() if v is not None})
        return out

    one, two = state(tables[0]), state(tables[1])
    assert one == two and len(one) == 9
    assert one["k1"] == ([1.0, 1.0], {"lang": "de", "seen": True}) and one["k2"][1] == {"lang": "fr", "seen": True, "place": 2}
    assert one["k8"][1] == {"lang": "en", "place": 80} and one["k0"][1] == {"lang": "en", "place": 0}


def test_sparse_scoring_stays_small():
    """What a task holds beside a batch follows neither the batch's rows nor how many queries share a term."""
    import tracemalloc

    rows, terms, asked = 10_000, 40, 200

    def column(n, value):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * terms + 1, terms, dtype=np.int32)), value)

    def vectors(n):
        return column(n, pa.array(np.tile(np.arange(terms, dtype=np.int32), n))), column(n, pa.array(np.tile(np.arange(1, terms + 1) / 1e6 * 1000, n)))

    block = SparseBlock(pa.table(dict(zip(["query_id", "indices", "values"], [pa.array(np.arange(asked)), *vectors(asked)]))))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(rows)]), *vectors(rows)], ["id", "indices", "values"])
    tracemalloc.start()
    scores = block.scores(batch.slice(0, block.rows_at_once()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert (scores == sum(x * x for x in range(1, terms + 1)) / 1e6).all()
