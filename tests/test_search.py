import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import search as s


def vectors(rng, n, dim, prefix):
    return [(f"{prefix}{i:04d}", [float(x) for x in rng.normal(size=dim).astype("float32")]) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    pts = vectors(rng, 300, 8, "p")
    # A third of all points are copies of one: ties are everywhere.
    pts += [(f"c{i:04d}", pts[0][1]) for i in range(150)]
    pts += [("zero", [0.0] * 8), ("short", [1.0] * 4), ("none", None)]
    qs = vectors(rng, 40, 8, "q") + [("q_copy", pts[0][1])]
    points = spark.createDataFrame(pts, "id string, dense array<float>").repartition(7)
    queries = spark.createDataFrame(qs, "query_id string, vector array<float>").repartition(3)
    return pts, qs, points, queries


def brute(pts, qs, k, metric):
    out = {}
    for qid, q in qs:
        q = np.array(q)
        found = []
        for pid, p in pts:
            if p is None or len(p) != len(q):
                continue
            p = np.array(p)
            if metric == "cosine":
                if not np.linalg.norm(p):
                    continue
                v, sign = p @ q / np.linalg.norm(p) / np.linalg.norm(q), -1
            elif metric == "dot":
                v, sign = p @ q, -1
            elif metric == "euclid":
                v, sign = np.linalg.norm(p - q), 1
            else:
                v, sign = np.abs(p - q).sum(), 1
            found.append((sign * round(float(v), 6), pid))
        out[qid] = [p for _, p in sorted(found)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid", "manhattan"])
@pytest.mark.parametrize("broadcast", [10**9, 2000])
def test_dense(data, metric, broadcast):
    pts, qs, points, queries = data
    found = s.dense_search(queries, points, 12, metric=metric, vector_size=8, broadcast_numbers=broadcast)
    assert as_lists(found) == brute(pts, qs, 12, metric)


def test_dense_small_slices(data, monkeypatch):
    from vecloom.operators import scoring

    pts, qs, points, queries = data
    monkeypatch.setattr(scoring, "CELLS", 100)
    monkeypatch.setattr(s, "CELL_NUMBERS", 500)
    found = s.dense_search(queries, points, 5, vector_size=8, broadcast_numbers=1000)
    assert as_lists(found) == brute(pts, qs, 5, "cosine")


def test_many_partitions_merge(spark, data):
    pts, qs, points, queries = data
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    try:
        assert as_lists(s.dense_search(queries, points.repartition(20), 12, vector_size=8)) == brute(pts, qs, 12, "cosine")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_expression(data):
    _, _, points, queries = data
    hits = s.dense_search(queries, points, 4, vector_size=8)
    scored = hits.withColumnRenamed("score", "block_score").join(points, "id")
    for r in s.dense_pairs(queries, scored).collect():
        assert abs(r.score - r.block_score) < 2e-6


def test_query_size_is_checked(data):
    _, _, points, queries = data
    with pytest.raises(Exception, match="expect vector size 8, got 3"):
        s.dense_search(queries.withColumn("vector", F.slice("vector", 1, 3)), points, 5, vector_size=8).collect()


@pytest.mark.parametrize("limit", [0, 1001, True, "5"])
def test_limits(data, limit):
    with pytest.raises(ValueError):
        s.dense_search(data[3], data[2], limit)


def test_unknown_metric(data):
    with pytest.raises(ValueError, match="Unsupported distance"):
        s.dense_search(data[3], data[2], 5, metric="hamming")


def test_no_queries(data):
    assert s.dense_search(data[3].limit(0), data[2], 5).count() == 0


# --- sparse ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def terms(spark):
    rng = np.random.default_rng(7)

    def vec(common):
        idx = sorted(set(rng.integers(0, 60, size=6).tolist()) | ({7} if common else set()))
        return (idx, [round(float(x), 6) for x in rng.random(len(idx))])

    pts = [(f"p{i:04d}", vec(i % 3 == 0)) for i in range(240)] + [("empty", ([], [])), ("none", None)]
    pts += [(f"c{i:04d}", pts[0][1]) for i in range(120)]
    qs = [(i, vec(True)) for i in range(30)] + [(99, ([], []))]
    kind = "struct<indices: array<int>, values: array<double>>"
    points = spark.createDataFrame(pts, f"id string, sparse {kind}").repartition(5)
    queries = spark.createDataFrame(qs, f"query_id bigint, sparse {kind}")
    return pts, qs, points, queries


def brute_sparse(pts, qs, k, idf=False):
    df, n = {}, 0
    for _, v in pts:
        if v and v[0]:
            n += 1
            for i in v[0]:
                df[i] = df.get(i, 0) + 1
    out = {}
    for qid, (qi, qv) in qs:
        weight = dict(zip(qi, qv))
        if idf:
            weight = {i: round(w * np.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)), 6) for i, w in weight.items() if i in df}
        found = []
        for pid, v in pts:
            shared = [(weight[i], x) for i, x in zip(*v) if i in weight] if v else []
            if shared:
                total = sum(round(a * 1e6) * round(x * 1e6) for a, x in shared)
                found.append((-((total + 500_000) // 1_000_000), pid))
        if found:
            out[qid] = [p for _, p in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("idf", [False, True])
@pytest.mark.parametrize("broadcast", [10**9, 2000])
def test_sparse(terms, idf, broadcast):
    pts, qs, points, queries = terms
    found = s.sparse_search(queries, points, 9, idf=idf, broadcast_numbers=broadcast)
    assert as_lists(found) == brute_sparse(pts, qs, 9, idf)


def test_sparse_small_slices(terms, monkeypatch):
    from vecloom.operators import scoring

    pts, qs, points, queries = terms
    monkeypatch.setattr(scoring, "CELLS", 40)
    assert as_lists(s.sparse_search(queries, points, 9)) == brute_sparse(pts, qs, 9)


def test_statistics(terms):
    pts, _, points, _ = terms
    got = {r["index"]: (r.df, r.n) for r in s.term_statistics(points).collect()}
    n = sum(1 for _, v in pts if v and v[0])
    want = {}
    for _, v in pts:
        for i in v[0] if v else []:
            want[i] = want.get(i, 0) + 1
    assert got == {i: (c, n) for i, c in want.items()}


# --- hybrid ---------------------------------------------------------------------------------------------


def test_hybrid_is_rank_fusion(spark):
    points = spark.createDataFrame(
        [("a", [1.0, 0.0], ([1], [0.5])), ("b", [0.9, 0.1], ([2], [0.9])), ("c", [0.0, 1.0], ([1, 2], [0.9, 0.9])), ("d", [0.1, 0.9], None)],
        "id string, dense array<float>, sparse struct<indices: array<int>, values: array<double>>",
    ).withColumn("lang", F.when(F.col("id") == "a", "en").otherwise("fr"))
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0], ([1, 2], [0.5, 0.7]))], "query_id int, vector array<float>, sparse struct<indices: array<int>, values: array<double>>"
    )
    got = [(r.id, r.score) for r in s.hybrid_search(queries, points, 3).orderBy("rank").collect()]
    # dense: a b d; sparse: c (1.08) b (0.63) a (0.25)
    want = {"a": 1 / 61 + 1 / 63, "b": 1 / 62 + 1 / 62, "c": 1 / 61, "d": 1 / 63}
    assert got == [(i, round(x, 9)) for i, x in sorted(want.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:3]]
    pre = s.hybrid_search(queries, points, 3, filter={"lang": "fr"}).collect()
    post = s.hybrid_search(queries, points, 3, filter={"lang": "fr"}, filter_stage="post").collect()
    assert {r.id for r in pre} == {"b", "c", "d"} == {r.id for r in post}
    with pytest.raises(ValueError):
        s.hybrid_search(queries, points, 3, filter_stage="later")


def test_modes(spark):
    rows = [
        ("explicit", "Dense", "hybrid", True, True, True, "dense"),
        ("logical", None, "sparse", True, True, True, "sparse"),
        ("has sparse", "auto", None, True, True, True, "hybrid"),
        ("no sparse", "auto", None, False, True, True, "dense"),
        ("no terms", "hybrid", None, True, False, True, "dense"),
        ("no vector", "hybrid", None, True, True, False, "sparse"),
        ("no sparse at all", "hybrid", None, None, True, True, "dense"),
    ]
    df = spark.createDataFrame(rows, "id string, search_mode string, default_mode string, has_sparse boolean, has_terms boolean, has_dense boolean, want string")
    for r in s.resolve_mode(df).collect():
        assert r.mode == r.want, r.id


def test_text_queries(spark):
    df = spark.createDataFrame([("a b", None), (None, "c"), ("x", "  "), ("x", "y")], "text string, query_text string")
    got = s.text_queries(df).collect()
    assert [r.dense_text for r in got] == ["a b", "c", "x", "x"]
    assert [len(r.sparse.indices) if r.sparse else None for r in got] == [2, 1, None, 1]
