import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions import vectors as V
from clickloom.operators import knn as K
from clickloom.operators import ranking as R
from clickloom.plans import recommend as REC


def table(spark, x, name="item_id", vec="embedding"):
    return spark.createDataFrame([(f"{name[0]}{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], f"{name} string, {vec} array<double>")


def brute(q, x, k):
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((1 + q @ x.T) / 2, 9)
    return {f"q{i:04d}": [f"i{j:04d}" for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]] for i in range(len(q))}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16)) * 4
    # A third of all items are copies of one vector, and a third of the queries sit on it.
    x = np.vstack([centres[rng.integers(0, 12, 400)] + rng.standard_normal((400, 16)), np.tile(centres[0], (200, 1))])
    q = np.vstack([centres[rng.integers(0, 12, 60)] + rng.standard_normal((60, 16)), centres[0] + 0.1 * rng.standard_normal((30, 16))])
    return x, q


@pytest.mark.parametrize("probes", [1, 3, 50])
def test_exact_search_equals_brute_force(spark, clustered, probes):
    x, q = clustered
    index = K.pivot_index(table(spark, x), clusters=12, block_items=40)
    got = K.search(table(spark, q, "query_id", "vec"), index, 15, n_probe=probes, query_group=8)
    assert found(got) == brute(q, x, 15)


def test_a_query_meets_a_bin_once_and_brings_k_hits(spark, clustered):
    x, q = clustered
    index, asked = K.kmeans_index(table(spark, x), clusters=12), table(spark, q, "query_id", "vec")
    probes = K.probe(asked, index, 5)
    assert probes.count() == len(q) and {len(r.cells) for r in probes.collect()} == {5}
    packed = K.score_bins(probes, index, 15).collect()
    assert len(packed) == len(q) and all(len(r.best) <= 15 for r in packed)


def test_running_best_equals_sorting():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)).round(1)
    x, q = x / np.linalg.norm(x, axis=1, keepdims=True), x[:20] / np.linalg.norm(x[:20], axis=1, keepdims=True)
    x[100:200] = x[50]  # ties are cut by place
    x[7] = np.nan
    best, place = np.full((20, 9), -1, dtype=np.int64), rng.permutation(300)
    for at in range(0, 300, 64):
        K.merge_best(best, np.arange(20), q @ x[at : at + 64].T, place[at : at + 64])
    row, found, score = K.hits_of(best)
    s = np.round((1 + q @ x.T) / 2, 9)
    for i in range(20):
        want = sorted((j for j in range(300) if j != 7), key=lambda j: (-s[i, j], place[j]))[:9]
        assert found[row == i].tolist() == place[want].tolist() and np.array_equal(score[row == i], s[i, want])


def test_exact_search_with_fewer_items_than_wanted(spark):
    x = np.eye(3)
    index = K.pivot_index(table(spark, x), clusters=3)
    got = found(K.search(table(spark, x, "query_id", "vec"), index, 10, n_probe=1))
    assert all(len(v) == 3 for v in got.values())


def test_zero_vectors_are_not_indexed_and_find_nothing(spark):
    x = np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 1.0]])
    index = K.pivot_index(table(spark, x))
    got = found(K.search(table(spark, np.array([[0.0, 0.0], [1.0, 1.0]]), "query_id", "vec"), index, 5))
    assert got == {"q0001": ["i0000", "i0002"]}


def test_approximate_indexes_find_most(spark, clustered):
    x, q = clustered
    items, queries = table(spark, x), table(spark, q, "query_id", "vec")
    exact = K.search(queries, K.pivot_index(items), 10)
    ivf = K.search(queries, K.kmeans_index(items, clusters=12), 10, n_probe=3, exact=False)
    lsh = K.search(queries, K.plane_index(items, bits=4), 10, n_probe=6, exact=False)
    assert K.recall(ivf, exact).first().recall > 0.9
    assert K.recall(lsh, exact).first().recall > 0.5
    with pytest.raises(ValueError):
        K.search(queries, K.plane_index(items), 10)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(V.unit("v").alias("u"), V.project_user("v", 4).alias("p"), V.is_zero("v").alias("z")).collect()
    assert rows[0].u == [0.6, 0.8] and rows[0].p == [0.6, 0.8, 0.0, 0.0] and not rows[0].z
    assert rows[1].u == [0.0, 0.0] and rows[1].p == [0.0] * 4 and rows[1].z


# ---------------------------------------------------------------- recommendation


@pytest.fixture(scope="module")
def serving(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 8))
    x[7] = -x[6]
    items = spark.createDataFrame(
        [(f"i{i:04d}", f"Product {i}", f"cat_{i % 5}", 10.0 + i if i % 4 else None, 4.0, 50 + i) for i in range(32)],
        "item_id string, title string, category string, price double, avg_rating double, review_count bigint",
    )
    vectors = table(spark, x)
    factors = spark.createDataFrame([("known", [1.0, 0.5]), ("zero", [0.0, 0.0])], "user_id string, features array<double>")
    history = spark.createDataFrame([("known", f"i{i:04d}") for i in range(10)] + [("cold", "i0031")], "user_id string, item_id string")
    tables = REC.Tables(items, vectors, factors, history, K.pivot_index(vectors), 8)
    req = [
        ("r1", "known", 5, ["i0003"]), ("r2", "seen", 5, ["i0003", "i0003", "i0004"]), ("r3", "lost", 5, ["nope"]),
        ("r4", "cold", 5, []), ("r5", "opposite", 5, ["i0006", "i0007"]), ("r6", "zero", 5, []),
    ]
    requests = spark.createDataFrame(
        [(a, b, c, 36000.0, {"device": "mobile"}, 2, 10.0, v, False, 1.0) for a, b, c, v in req],
        "request_id string, user_id string, n_recommendations int, request_ts double, context map<string,string>, session_length bigint, "
        "session_age_seconds double, recent_views array<string>, has_cart_item boolean, last_seen_timestamp double",
    )
    return requests, tables, x


WEIGHTS = {f: 0.0 for f in R.FEATURES} | {"candidate_review_count": 1.0}


def test_retrieval_ways(spark, serving):
    requests, t, x = serving
    rows = REC.candidates(requests, t.factors, t.vectors, t.items, t.index, 8, n=10, exact=True).collect()
    way = {}
    for r in rows:
        way.setdefault(r.request_id, set()).add(r.source)
    # r3: views without any vector give nothing; r5: opposite vectors cancel, so the search is refused.
    assert way == {"r1": {"cf"}, "r2": {"session"}, "r4": {"popular"}, "r5": {"popular"}, "r6": {"popular"}}
    mean = (2 * x[3] + x[4]) / 3
    want = brute(mean[None, :], x, 10)["q0000"]
    assert [r.item_id for r in sorted((r for r in rows if r.request_id == "r2"), key=lambda r: r.retrieval_rank)] == want
    assert [r.item_id for r in sorted((r for r in rows if r.request_id == "r4"), key=lambda r: r.retrieval_rank)][:2] == ["i0031", "i0030"]


def test_recommendations_leave_the_history_out(spark, serving):
    requests, t, _ = serving
    top = REC.recommend(requests, t, R.linear_scorer(WEIGHTS), n=30, exact=True)
    rows = {r.request_id: r for r in REC.respond(requests, top).collect()}
    assert len(rows) == 6
    ids = [x["item_id"] for x in rows["r1"].recommendations]
    assert ids == [f"i{i:04d}" for i in range(29, 24, -1)]
    assert all(int(x["item_id"][1:]) >= 10 for x in rows["r1"].recommendations)
    assert "i0031" not in [x["item_id"] for x in rows["r4"].recommendations] and len(rows["r4"].recommendations) == 5
    assert rows["r3"].recommendations == [] and rows["r3"].status == "cold_start" and rows["r3"].diversity == 0.0
    assert rows["r1"].diversity == 1.0 and rows["r1"].status == "success"


def test_feature_values(spark, serving):
    requests, t, _ = serving
    rows = {(r.request_id, r.item_id): r for r in REC.features(requests, t, n=30, exact=True).collect()}
    r = rows[("r1", "i0003")]
    assert r.candidate_in_recent_views and r.n_recent_views == 1 and r.device_mobile
    assert r.time_of_day == pytest.approx(10 / 23) and r.candidate_price == 13.0
    assert rows[("r1", "i0004")].candidate_price == 0.0


@pytest.mark.parametrize("cats, want", [("AAAAAAAAAA", 0.1), ("ABCDEFGHIJ", 1.0), ("AAABB", 0.4), ("XYX", 2 / 3)])
def test_diversity(spark, cats, want):
    req = spark.createDataFrame([("r", "u")], "request_id string, user_id string")
    top = spark.createDataFrame(
        [("r", i + 1, f"i{i}", "t", c, 1.0, 1.0, 1.0, "cf") for i, c in enumerate(cats)],
        "request_id string, rank int, item_id string, title string, category string, price double, avg_rating double, score double, source string",
    )
    assert REC.respond(req, top).first().diversity == pytest.approx(want)


def test_a_norm_is_computed_once_per_vector(spark):
    rows = spark.createDataFrame(
        [("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, None]), ("e", [])], "id string, v array<double>"
    )
    out = rows.select("id", V.project_user("v", 3).alias("v")).select("id", V.unit("v").alias("v"))
    # a norm inside a lambda would be computed for every element, and one vector of another for every element of that
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    got = {r.id: r.v for r in out.collect()}
    assert np.allclose(got["a"], [0.6, 0.8, 0.0])
    assert got["b"] == [0.0] * 3 and got["c"] is None and got["d"] == [1.0, None, 0.0] and got["e"] == [0.0] * 3
