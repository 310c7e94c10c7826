import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.operators import catalogue as C
from clickloom.operators import messages as M
from clickloom.sources import datasets as D


@pytest.mark.parametrize(
    "raw, want",
    [("$1,234.50", 1234.5), ("n/a", None), (None, None), (" 12 ", 12.0), ("", None), ("NaN", None), ("7", 7.0)],
)
def test_price(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "p string").select(S.parse_price("p").alias("v"), S.safe_float("p").alias("z"))
    assert df.first().v == want


def test_safe_float_is_never_missing(spark):
    df = spark.createDataFrame([("x",), (None,), ("NaN",), ("3.5",)], "p string")
    assert [r.z for r in df.select(S.safe_float("p").alias("z")).collect()] == [0.0, 0.0, 0.0, 3.5]


def test_pages(spark):
    df = spark.createDataFrame([("view",), ("add_to_cart",), ("purchase",), ("search",), ("other",), (None,)], "t string")
    assert [r.p for r in df.select(S.page_for("t").alias("p")).collect()] == ["product", "cart", "cart", "search", "home", "home"]


def _filtered(rows, mu, mi, passes=2):
    for _ in range(passes):
        c = Counter(u for u, *_ in rows)
        rows = [r for r in rows if c[r[0]] >= mu]
        c = Counter(r[1] for r in rows)
        rows = [r for r in rows if c[r[1]] >= mi]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_activity_filter_runs_exactly_two_passes(spark, seed):
    rng = random.Random(seed)
    # One user and one item hold a third of all rows.
    rows = [(f"u{0 if rng.random() < 0.33 else rng.randint(1, 60)}", f"i{0 if rng.random() < 0.33 else rng.randint(1, 50)}", float(n)) for n in range(900)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, rating double")
    got = sorted(tuple(r) for r in C.activity_filter(df, 9, 8).collect())
    assert got == sorted(_filtered(rows, 9, 8))
    assert len(got) < len(rows)


def test_dense_grid_passes_the_default_filter(spark):
    rows = [(f"user_{u}", f"item_{i}", 4.0) for u in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, rating double")
    assert C.activity_filter(df).count() == 300


def test_reviews_with_bad_times_go(spark):
    df = spark.createDataFrame(
        [("u", "a", 4.0, "1700000000", True), ("u", "b", 4.0, "abc", True), (None, "c", 4.0, "1", True), ("u", "d", None, "1", None)],
        "user_id string, asin string, rating double, timestamp string, verified_purchase boolean",
    )
    assert [r.item_id for r in C.clean_reviews(df).collect()] == ["a"]


def test_items_defaults_and_first_row_wins(spark):
    rows = [
        (1, "p1", "p1", None, None, "n/a", None, None, None),
        (2, "", "p2", "T", ["Cat", "x"], "$5", 4.5, 7, ["a" * 150, None, "b" * 150]),
        (3, "p1", "p1", "later", ["C"], "1", 1.0, 1, ["z"]),
        (4, "p9", "p9", "not wanted", [], "1", 1.0, 1, []),
    ]
    meta = spark.createDataFrame(
        rows,
        "row_order int, parent_asin string, asin string, title string, categories array<string>, price string, "
        "average_rating double, rating_number bigint, description array<string>",
    )
    valid = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "item_id string")
    got = {r.item_id: r for r in C.clean_items(meta, valid).collect()}
    assert set(got) == {"p1", "p2"}
    assert tuple(got["p1"])[1:] == ("", "Unknown", None, 0.0, 0, "")
    assert got["p2"].category == "Cat" and got["p2"].price == 5.0
    assert got["p2"].description_snippet == ("a" * 150 + " " + "b" * 150)[:200]


@pytest.mark.parametrize(
    "values, in_ms",
    [([1.7e9, 1.6e9, 2e12], False), ([1.7e12, 1.6e12, 5.0], True), ([9e11, 1.2e12], True), ([1e9, 1.5e12], False), ([None], False)],
)
def test_epoch_units_follow_the_median(spark, values, in_ms):
    df = spark.createDataFrame([(v,) for v in values], "timestamp double")
    got = sorted(r.epoch for r in C.normalise_epochs(df).select("epoch").collect())
    kept = sorted(v for v in values if v is not None)
    assert got == pytest.approx([v / 1000 if in_ms else v for v in kept])


def test_history_upsert_replaces_whole_users(spark):
    cols = "user_id string, item_id string"
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], cols)
    new = spark.createDataFrame([("a", "9")], cols)
    assert sorted(tuple(r) for r in C.upsert_history(old, new).collect()) == [("a", "9"), ("b", "3")]
    assert C.upsert_history(old, new.limit(0)).count() == 3


def test_build_or_reuse(spark, tmp_path):
    calls = []
    rows = spark.createDataFrame([(f"u{u}", f"i{i}", 1.0) for u in range(12) for i in range(6)], "user_id string, item_id string, rating double")

    def inter():
        calls.append(1)
        return rows

    items = lambda valid: valid.select("item_id").distinct()
    for force, n in ((False, 1), (False, 1), (True, 2)):
        a, b = D.build_or_reuse(spark, str(tmp_path / "d"), inter, items, force=force)
        assert len(calls) == n and a.count() == 72 and b.count() == 6


def test_index_is_written_once(spark, tmp_path):
    items = spark.createDataFrame([("a", "T", "C", float("nan"), 4.0, 3), ("b", "T", "C", 1.0, 4.0, 3), ("c", "T", "C", 1.0, 4.0, 3)],
                                  "item_id string, title string, category string, price double, avg_rating double, review_count bigint")
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 0.0])], "item_id string, embedding array<double>")
    rows = C.index_rows(items, emb).withColumn("cluster_id", F.lit(0))
    assert D.write_index(spark, rows, str(tmp_path / "ix")) and not D.write_index(spark, rows, str(tmp_path / "ix"))
    got = spark.read.parquet(str(tmp_path / "ix")).collect()
    assert [(r.item_id, r.price) for r in got] == [("a", 0.0)]


def test_messages_roundtrip_and_dead_letters(spark):
    ev = spark.createDataFrame(
        [("1", "u", None, "view", "s", 1.7e9 + 0.25, None), ("2", None, "i", "view", "s", 1.0, {"device": "mobile"})],
        "event_id string, user_id string, item_id string, event_type string, session_id string, timestamp double, metadata map<string,string>",
    )
    msgs = M.encode_events(ev)
    assert {r.key for r in msgs.collect()} == {"u", ""}
    bad = spark.createDataFrame([("k", "{not json", "9")], "key string, value string, event_id string")
    good, dead = M.parse_events(msgs.unionByName(bad))
    rows = good.collect()
    assert [(r.event_id, r.timestamp, r.metadata) for r in rows] == [("1", 1700000000.25, {})]
    assert dead.count() == 2


def test_request_bounds(spark):
    req = spark.createDataFrame(
        [("a", "u", 0, None), ("b", "u", 1, None), ("c", "u", 50, None), ("d", "u", 51, None), ("e", "u", None, None), ("f", None, 5, None)],
        "request_id string, user_id string, n_recommendations int, context map<string,string>",
    )
    got = {r.request_id: (r.n_recommendations, r.reason is None) for r in M.validate_requests(req).collect()}
    assert got == {"a": (0, False), "b": (1, True), "c": (50, True), "d": (51, False), "e": (10, True), "f": (5, False)}
