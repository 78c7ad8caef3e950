import pytest
from pyspark.sql import functions as F

from vecloom.operators import validate as v
from vecloom.spec import Catalog, CollectionSpec, Model

INF = float("inf")


def reasons(df, rules):
    return [r.reason for r in v.check(df, rules).collect()]


def test_dense(spark):
    df = spark.createDataFrame([([0.1, float("nan")],), ([],), ([1.0, -INF],), ([1.0],), (None,), ([None],)], "vector array<double>")
    assert reasons(df, v.dense_rules(F.col("vector"), "vector")) == [
        "'vector[1]' must be a finite number", "'vector' must not be empty", "'vector[1]' must be a finite number", None, None,
        "'vector[0]' must be a finite number",
    ]


@pytest.mark.parametrize(
    ("indices", "values", "reason"),
    [
        ([1, 3], [0.2, 0.4], None),
        ([3, 2], [0.1, 0.1], "'v.indices' must be strictly increasing"),
        ([2, 2], [0.1, 0.1], "'v.indices' must be strictly increasing"),
        ([-1, 2], [0.1, 0.1], "'v.indices[0]' must be non-negative"),
        ([5, 3, -1], [0.1] * 3, "'v.indices' must be strictly increasing"),
        ([5, -1], [0.1] * 2, "'v.indices[1]' must be non-negative"),
        ([], [], "'v.indices' must not be empty"),
        ([1], [0.1, 0.2], "'v' sparse vector requires the same number of indices and values"),
        (None, [0.1], "'v' sparse vector must include list 'indices' and 'values'"),
        ([1], [INF], "'v.values[0]' must be a finite number"),
    ],
)
def test_sparse(spark, indices, values, reason):
    df = spark.createDataFrame([((indices, values),)], "v struct<indices: array<int>, values: array<double>>")
    assert reasons(df, v.sparse_rules(F.col("v"), "v")) == [reason]


QUERY = "text string, query_text string, vector array<double>, limit int, search_mode string"


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ((None, "find this", None, 5, None), None),
        (("a", None, None, 5, "lexical"), "'search_mode' must be one of: auto, dense, sparse, hybrid"),
        (("a", None, [1.0], 5, "SPARSE"), "'vector' is not allowed when 'search_mode' is 'sparse'"),
        ((None, None, [1.0], 5, "Hybrid"), None),
        ((None, None, None, 5, None), "One of 'text', 'query_text', or 'vector' is required"),
        (("  ", None, [1.0], 5, None), "'text' must not be blank"),
        ((None, "", [1.0], 5, None), "'query_text' must not be blank"),
        (("a", None, None, 0, None), "'limit' must be between 1 and 1000"),
        (("a", None, None, 1001, None), "'limit' must be between 1 and 1000"),
        (("a", None, [], 5, None), "'vector' must not be empty"),
    ],
)
def test_queries(spark, row, reason):
    assert reasons(spark.createDataFrame([row], QUERY), v.query_rules()) == [reason]


def test_embed_requests(spark):
    df = spark.createDataFrame([("one", ["two"]), (None, None), (None, ["ok", "  "]), ("x", None), ("x", []), (" ", None)], "text string, texts array<string>")
    assert reasons(df, v.embed_rules()) == [
        "Provide either 'text' or 'texts', not both", "One of 'text' or 'texts' is required", "'texts[1]' must not be blank", None, None, "'text' must not be blank",
    ]


def test_sizes_and_models(spark):
    df = spark.createDataFrame([([0.0] * 384, "default"), ([0.0] * 2, "small"), (None, "unknown")], "vector array<double>, model string")
    rules = v.size_rules(F.col("vector"), F.lit("kb"), F.lit(2))
    assert reasons(df, rules) == ["Collection 'kb' expects dense vector size 2, got 384", None, None]
    catalog = Catalog((CollectionSpec("kb", 1024),), models=(Model("default", "m", 1024), Model("small", "s", 384)))
    got = reasons(df.withColumn("physical", F.lit("kb")), v.model_rules(catalog, "query"))
    assert got == [None, "Model 'small' produces 384-dim vectors but collection 'kb' expects 1024 for query", None]


def test_targets(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), ([1.0, 2.0], None)], "dense array<float>, other array<float>")
    catalog = Catalog((CollectionSpec("kb", 2, vector_name="dense"),))
    assert reasons(df, v.target_rules(df, catalog, ["kb"], ["dense", "other"])) == ["Collection 'kb' requires a dense vector payload for upsert", None]


def test_split_and_strict(spark):
    df = spark.createDataFrame([("1", "a"), ("2", " ")], "id string, text string")
    good, bad = v.split(df, v.text_rules("text"))
    assert [r.id for r in good.collect()] == ["1"] and good.columns == df.columns
    assert [(r.id, r.reason) for r in bad.collect()] == [("2", "'text' must not be blank")]
    assert v.strict(df.filter("id = '1'"), v.text_rules("text")).count() == 1
    with pytest.raises(Exception, match="must not be blank"):
        v.strict(df, v.text_rules("text")).count()


def test_request_sizes(spark):
    rows = spark.createDataFrame([(1,)] * 3 + [(2,)], "r int")
    requests = spark.createDataFrame([(1,), (2,), (3,)], "r int")
    got = {x.r: (x.n, x.reason) for x in v.request_sizes(rows, requests, "r", "ids", cap=2).collect()}
    assert got == {1: (3, "'ids' must contain at most 2 items"), 2: (1, None), 3: (0, "'ids' must not be empty")}


def test_specs_and_patches(spark):
    df = spark.createDataFrame(
        [("a", 0, None, None, []), ("a", 4, "x", "x", []), ("a", 4, None, None, ["p", "p"]), ("a", 4, None, None, None), (" ", 4, None, None, [])],
        "collection string, vector_size int, vector_name string, sparse_vector_name string, aliases array<string>",
    )
    assert reasons(df, v.spec_rules()) == [
        "'vector_size' must be greater than 0", "'vector_name' and 'sparse_vector_name' must be different", "'aliases' must not contain duplicates", None,
        "'collection' must not be blank",
    ]
    patches = spark.createDataFrame([("1", {}), ("1", {"a": "b"}), (" ", {"a": "b"}), ("1", None)], "id string, patch map<string,string>")
    assert reasons(patches, v.patch_rules()) == ["'payload' must not be empty", None, "'id' must not be blank", "'payload' must not be empty"]
