"""Requests with their own filter, collection, mode and limit against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vecloom.functions.text import sparse_terms
from vecloom.operators.embed import HashEmbedder
from vecloom.operators.search import term_statistics
from vecloom.operators.service import Served, mask_columns, search_service
from vecloom.spec import Catalog, CollectionSpec, Model

REQUEST = "query_id string, collection string, text string, query_text string, vector array<double>, search_mode string, limit int, filter string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()
A = CollectionSpec("a", 3, sparse_vector_name="sparse", sparse_modifier="idf")
B = CollectionSpec("b", 2, distance="Euclid", vector_name="v")


@pytest.fixture(scope="module")
def collections(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(WORDS, k=rng.randrange(0, 6))) if i % 9 else None
        dense = [float(rng.randrange(-3, 4)) for _ in range(3)] if i % 7 else ([1.0] if i % 2 else None)
        rows.append((f"p{i:03d}", dense, text, rng.choice(["en", "de", None]), i, json.dumps({"n": i % 5}) if i % 3 else None))
    points = spark.createDataFrame(rows, "id string, dense array<double>, text string, lang string, place int, extra string").withColumn(
        "sparse", F.when(F.col("text").isNotNull(), sparse_terms(F.col("text")))
    )
    other = spark.createDataFrame([(f"q{i:02d}", [float(i % 4), float(i // 4)], i % 3) for i in range(40)], "id string, v array<double>, kind int")
    return {"a": Served(points, A, term_statistics(points)), "b": Served(other, B)}


def holds(spec, row):
    if not spec:
        return True
    if "place" in spec:
        return row["place"] in spec["place"]
    if "must" in spec:
        return row["place"] is not None and row["place"] >= spec["must"][0]["range"]["gte"]
    if "n" in spec:
        return row["extra"] is not None and json.loads(row["extra"])["n"] == spec["n"]
    if "kind" in spec:
        return row["kind"] == spec["kind"]
    return row["lang"] == spec["lang"]


def round6(x):
    return math.trunc(x * 1e6 + math.copysign(0.5, x)) / 1e6


def brute(request, served, mode):
    """The answer of one request, by looking at every point."""
    rows = [r.asDict() for r in served.points.collect()]
    rows = [r for r in rows if holds(json.loads(request["filter"] or "{}"), r)]
    limit, branches = request["limit"] or 5, {}
    if mode in ("dense", "hybrid"):
        scored = []
        for r in rows:
            v = r[served.spec.dense_column]
            if v is None or len(v) != served.spec.vector_size:
                continue
            if served.spec.distance == "Euclid":
                scored.append((round6(math.dist(v, request["vector"])), r["id"]))
            elif any(v) and any(request["vector"]):
                scored.append((-round6(sum(x * y for x, y in zip(v, request["vector"])) / math.hypot(*v) / math.hypot(*request["vector"])), r["id"]))
        sign = 1 if served.spec.distance == "Euclid" else -1
        branches["dense"] = [(i, sign * s + 0.0) for s, i in sorted(scored)[:limit]]
    if mode in ("sparse", "hybrid"):
        terms = request["_terms"]
        stats = {r["index"]: (r["df"], r["n"]) for r in served.statistics.collect()}
        scored = []
        for r in rows:
            if r["sparse"] is None:
                continue
            have = dict(zip(r["sparse"]["indices"], r["sparse"]["values"]))
            shared = [i for i in terms if i in have and i in stats]
            if shared:
                weight = {i: round(terms[i] * math.log(1 + (stats[i][1] - stats[i][0] + 0.5) / (stats[i][0] + 0.5)), 6) for i in shared}
                total = sum(round(weight[i] * 1e6) * round(have[i] * 1e6) for i in shared)
                scored.append((-(math.floor((total + 500_000) / 1_000_000) / 1e6), r["id"]))
        branches["sparse"] = [(i, -s) for s, i in sorted(scored)[:limit]]
    if mode != "hybrid":
        return [(rank, i, s) for rank, (i, s) in enumerate(branches[mode], 1)]
    fused = {}
    for hits in branches.values():
        for rank, (i, _) in enumerate(hits, 1):
            fused[i] = fused.get(i, 0.0) + 1 / (60 + rank)
    best = sorted((-round(s, 9), i) for i, s in fused.items())[:limit]
    return [(rank, i, -s) for rank, (s, i) in enumerate(best, 1)]


def make_requests():
    rng, rows = random.Random(3), []
    filters = [None, "{}", '{"lang": "en"}', '{"n": 2}', *[json.dumps({"place": [i, i + 1, i + 40]}) for i in range(70)]]
    filters += [json.dumps({"must": [{"key": "place", "range": {"gte": i}}]}) for i in range(0, 100, 20)]
    for n, f in enumerate([*filters, *filters[:4]]):
        mode = ["dense", "sparse", "hybrid", "auto", None][n % 5]
        text = " ".join(rng.choices(WORDS, k=3))
        vector = [float(rng.randrange(-2, 3)) or 1.0 for _ in range(3)] if mode != "sparse" else None
        rows.append((f"r{n:03d}", ["a", "logical"][n % 2], text, None, vector, mode, rng.choice([None, 1, 3, 9]), f))
    for n in range(6):
        rows.append((f"s{n}", "b", None, None, [1.0, float(n)], "auto", 2 + n, [None, '{"kind": 1}', '{"kind": 2}'][n % 3]))
    return rows


@pytest.mark.parametrize("filters_at_once, broadcast_numbers", [(256, 8_000_000), (10, 8_000_000), (256, 2_000)])
def test_service_against_brute_force(spark, collections, filters_at_once, broadcast_numbers):
    rows = make_requests()
    requests = spark.createDataFrame(rows, REQUEST)
    terms = {
        r["query_id"]: dict(zip(r["s"]["indices"], r["s"]["values"]))
        for r in requests.where("text is not null").select("query_id", sparse_terms(F.col("text")).alias("s")).collect()
    }
    routing = spark.createDataFrame([("logical", "a", "dense")], "logical_name string, read_target string, default_mode string")
    hits, rejected = search_service(
        requests, collections, routing=routing, filters_at_once=filters_at_once, broadcast_numbers=broadcast_numbers
    )
    assert rejected.count() == 0
    got = {}
    for h in hits.collect():
        got.setdefault(h["query_id"], []).append((h["rank"], h["id"], h["score"], h["mode"], h["collection"]))
    names = [c.split(" ")[0] for c in REQUEST.split(", ")]
    for row in rows:
        request = dict(zip(names, row)) | {"_terms": terms.get(row[0])}
        asked = (request["search_mode"] or "auto").lower()
        mode = asked if asked != "auto" else {"logical": "dense", "a": "hybrid", "b": "dense"}[request["collection"]]
        want = brute(request, collections["b" if request["collection"] == "b" else "a"], mode)
        mine = sorted(got.get(row[0], []))
        assert [(r, i) for r, i, *_ in mine] == [(r, i) for r, i, _ in want], row
        assert [s for _, _, s, *_ in mine] == pytest.approx([s for *_, s in want], abs=1.1e-6)
        assert all(m == mode and c == request["collection"] for *_, m, c in mine)


def test_service_rejects(spark, collections):
    rows = [
        ("none", "a", None, None, None, None, None, None), ("limit0", "a", "x", None, [1.0, 0.0, 0.0], None, 0, None),
        ("limit2000", "a", "x", None, [1.0, 0.0, 0.0], None, 2000, None), ("mode", "a", "x", None, None, "lexical", None, None),
        ("where", "zz", "x", None, None, None, None, None), ("size", "a", None, None, [1.0], None, None, None),
        ("json", "a", None, None, [1.0, 0.0, 0.0], None, None, "{"), ("list", "a", None, None, [1.0, 0.0, 0.0], None, None, "[1]"),
        ("clause", "a", None, None, [1.0, 0.0, 0.0], None, None, '{"must": [{"match": 1}]}'),
        ("blank", "a", "?!", None, None, "sparse", None, None), ("dense", "a", "alpha", None, None, "dense", None, None),
        ("nosparse", "b", "alpha", None, None, "sparse", None, None), ("fine", "a", "?!", None, [1.0, 0.0, 0.0], "sparse", None, None),
        ("also", "a", None, None, [1.0, 0.0, 0.0], None, 1000, "null"),
    ]
    hits, rejected = search_service(spark.createDataFrame(rows, REQUEST), collections)
    reasons = {r["query_id"]: r["reason"] for r in rejected.collect()}
    assert set(reasons) == {r[0] for r in rows} - {"fine", "also"} and all(reasons.values())
    assert {h["mode"] for h in hits.collect()} == {"dense"}
    none, _ = search_service(spark.createDataFrame(rows[:1], REQUEST), collections)
    assert none.count() == 0 and none.columns == hits.columns


def test_one_scan_of_each_collection(spark, collections, tmp_path):
    stored = {}
    for name, served in collections.items():
        served.points.write.parquet(str(tmp_path / name))
        stored[name] = Served(spark.read.parquet(str(tmp_path / name)), served.spec, served.statistics)
    hits, _ = search_service(spark.createDataFrame(make_requests(), REQUEST).where("collection <> 'logical'"), stored)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert {name: plan.count("MapInArrow") for name in ["any"]} == {"any": 4}
    # Both branches read the same candidates, so Spark runs each scan once.
    executed = hits._jdf.queryExecution().executedPlan().toString()
    assert executed.count(f"{tmp_path}/a") <= 2 and executed.count(f"{tmp_path}/b") <= 2


def test_missing_vectors_are_embedded(spark, collections):
    rows = [("t", "b", "alpha beta", None, None, None, 3, None), ("q", "b", None, "gamma", None, "dense", 3, None)]
    hits, rejected = search_service(spark.createDataFrame(rows, REQUEST), collections, embedders={"b": HashEmbedder(2)})
    assert rejected.count() == 0 and hits.groupBy("query_id").count().where("count = 3").count() == 2


def test_each_request_by_its_model(spark, collections):
    """A request's own model, else its collection's; one of another size does not fit, one that is not there is unknown."""
    two = CollectionSpec("b", 2, distance="Euclid", vector_name="v", models={"query": "two"})
    catalog = Catalog((A, two), models=(Model("two", "t", 2, unit_length=False), Model("three", "h", 3), Model("also", "u", 2), Model("gone", "g", 2)))
    rows = [
        ("own", "b", "alpha beta", None, None, None, 3, None, None), ("asked", "b", "alpha beta", None, None, None, 3, None, "also"),
        ("wide", "b", "alpha", None, None, None, 3, None, "three"), ("lost", "b", "alpha", None, None, None, 3, None, "gone"),
        ("given", "b", None, None, [1.0, 1.0], None, 3, None, "gone"), ("none", "b", None, None, None, None, 3, None, None),
    ]
    embedders = {"two": HashEmbedder(2), "three": HashEmbedder(3), "also": HashEmbedder(2)}
    hits, rejected = search_service(spark.createDataFrame(rows, REQUEST + ", model string"), {"b": Served(collections["b"].points, two)}, embedders=embedders, catalog=catalog)
    reasons = {r["query_id"]: r["reason"] for r in rejected.collect()}
    assert set(reasons) == {"wide", "lost", "none"} and "produces 3-dim vectors" in reasons["wide"] and reasons["lost"] == "Unknown model: gone"
    got = {}
    for h in hits.collect():
        got.setdefault(h["query_id"], {})[h["rank"]] = h["score"]
    assert set(got) == {"own", "asked", "given"} and all(len(v) == 3 for v in got.values())
    # The same text, once as it comes from the model and once at unit length.
    assert got["own"] != got["asked"]


def test_masks(spark):
    points = spark.range(200).select(F.col("id").cast("int").alias("x"))
    specs = [{"x": i} for i in range(130)]
    mask, wanted = mask_columns(points, specs)
    found = {r["x"]: r["m"] for r in points.where(wanted).select("x", mask.alias("m")).collect()}
    assert set(found) == set(range(130))
    for x, words in found.items():
        bits = [(words[i // 64] >> (i % 64)) & 1 for i in range(130)]
        assert bits == [int(i == x) for i in range(130)]
    assert mask_columns(points, [None, {"x": 1}])[1] is None
