import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from clickloom.operators import ordering as O
from clickloom.operators import quality, sampling
from clickloom.operators import telemetry as TM


def test_positions_and_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 3), rng.randint(1, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, g int, w int").repartition(7)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.id: r.position for r in O.global_index(df, F.desc("g"), F.col("id")).collect()}
    assert got == {r[0]: n + 1 for n, r in enumerate(want)}
    sums = {r.id: r.upto for r in O.running_totals(df, [F.desc("g"), F.col("id")], {"upto": F.col("w")}).collect()}
    assert sums == dict(zip((r[0] for r in want), accumulate(r[2] for r in want)))


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_exact_latency(spark, n):
    rng = random.Random(n)
    v = sorted(rng.choice([1.0, 2.0, 2.0, 9.5, 30.25]) for _ in range(n))
    got = TM.latency_exact(spark.createDataFrame([(x,) for x in v], "total_ms double")).first()
    mid = (v[(n - 1) // 2] + v[n // 2]) / 2
    assert (got.p50_ms, got.p99_ms) == (mid, v[int(n * 0.99)])


def test_auc_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), float(rng.choice([1, 1, 1, 2, 3, 4]))) for _ in range(300)]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = quality.roc_auc(spark.createDataFrame(rows, "label int, score double")).first()
    assert got.auc == pytest.approx(want)
    one = quality.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()
    assert one.auc is None


def test_precision_and_recall(spark):
    recs = spark.createDataFrame([("a", f"i{k}", k) for k in range(1, 13)] + [("b", "x", 1)], "user_id string, item_id string, rank int")
    truth = spark.createDataFrame([("a", "i1"), ("a", "i1"), ("a", "i2"), ("a", "i12"), ("a", "zz"), ("b", "y"), ("c", "q")], "user_id string, item_id string")
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    got = quality.precision_recall(recs, truth, users).first()
    assert (got.users, got.precision_at_k, got.recall_at_k) == (2, pytest.approx(0.1), pytest.approx(0.25))
    none = quality.precision_recall(recs, truth, users.limit(0)).first()
    assert (none.precision_at_k, none.recall_at_k) == (0.0, 0.0)


def test_samples(spark):
    users = spark.createDataFrame([(f"u{i % 40}",) for i in range(100)], "user_id string")
    a = {r.user_id for r in sampling.sample_share(users, "user_id", 0.1).collect()}
    assert len(a) == 4 and a == {r.user_id for r in sampling.sample_share(users.repartition(9), "user_id", 0.1).collect()}
    assert sampling.sample_share(users.limit(3), "user_id", 0.1).count() == 1
    assert sampling.sample_count(users, "user_id", 99).count() == 40


def test_split_is_exact_per_label(spark):
    rows = spark.createDataFrame([(f"r{i}", int(i % 10 == 0)) for i in range(500)], "id string, y int")
    got = {(r.y, r.is_validation): r["count"] for r in sampling.stratified_split(rows, "id", "y").groupBy("y", "is_validation").count().collect()}
    assert got == {(0, True): 90, (0, False): 360, (1, True): 10, (1, False): 40}


def test_weighted_sample_prefers_heavy_keys(spark):
    rows = spark.createDataFrame([(f"k{i}", 1000.0 if i < 10 else 0.001) for i in range(200)] + [("never", 0.0)], "k string, w double")
    got = {r.k for r in sampling.weighted_sample(rows, "k", "w", 10).collect()}
    assert got == {f"k{i}" for i in range(10)}


def test_quantiles_inside_buckets(spark):
    log = spark.createDataFrame([(0.0, 0.0, x) for x in [4.0, 8.0, 20.0, 20.0]] + [(0.0, 0.0, 5000.0)], "retrieval_ms double, ranking_ms double, total_ms double")
    log = log.withColumn("ts", F.timestamp_seconds(F.lit(30)))
    got = {r.stage: r for r in TM.latency_quantiles(log, "1 minute", "1 minute").collect()}
    # rank 2.5 lies in (0.01, 0.025], which holds the 3rd and 4th value
    assert got["total"].p50 == pytest.approx(0.01 + 0.015 * 0.5 / 2)
    assert got["total"].p99 == 1.0
    assert got["ranking"].p95 == pytest.approx(0.005 * 0.95)


def test_histogram_is_cumulative(spark):
    log = spark.createDataFrame([(5,), (10,), (11,), (999,)], "n_candidates int")
    got = {r.le: r.n for r in TM.candidate_histogram(log).collect()}
    assert got["10.0"] == 2 and got["25.0"] == 3 and got["200.0"] == 3 and got["+Inf"] == 4
