import random
import time

from pyspark.sql import functions as F
from test_sessions import make, random_events

from clickloom.operators import messages as M
from clickloom.operators import sessions as E
from clickloom.sources import feeds
from clickloom.streaming import live as L


def land(spark, path, parts):
    for part in parts:
        # One file per part: the stream takes one file per batch.
        out = feeds.publish(M.encode_events(make(spark, part).coalesce(1).withColumn("metadata", F.create_map().cast("map<string,string>"))), "parquet", path=path)
        assert out.messages == len(part) and out.per_second > 0
    return L.parse(feeds.folder_stream(spark, path, 1)).filter("ok")


def test_session_state_with_late_files_equals_batch(spark, tmp_path):
    rows = sorted(random_events(9, 400), key=lambda r: r[4])
    # Rows are shuffled over neighbouring files: late by up to a third of the time line.
    rng = random.Random(1)
    files = [[] for _ in range(5)]
    for i, r in enumerate(rows):
        files[min(4, max(0, i * 5 // len(rows) + rng.choice([0, 0, 1])))].append(r)
    stream = land(spark, str(tmp_path / "in"), files)
    state = L.session_state(stream, 1800, delay="60000 seconds")
    L.to_batches(state, str(tmp_path / "out"), str(tmp_path / "cp"), drain=True)
    got = {r.user_id: r for r in L.latest_state(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {r.user_id: r for r in E.current_sessions(E.runs(make(spark, rows))).collect()}
    views = {r.user_id: r.recent_views for r in E.view_lists(E.recent_views(E.view_runs(make(spark, rows)))).collect()}
    assert set(got) == set(want)
    for u, w in want.items():
        g = got[u]
        assert (g.session_start, g.last_seen, g.session_length, g.has_cart_item) == (w.session_start, w.last_seen, w.session_length, w.has_cart_item)
        assert g.recent_views == views.get(u, [])


def test_users_of_a_bucket_have_states_of_their_own(spark, tmp_path, monkeypatch):
    """Every user was an entry of the store. Users who rest keep their state, and an expired one begins anew."""
    monkeypatch.setattr(L, "BUCKETS", 1)
    t0 = 1.7e9
    files = [
        [(f"a{i}", f"u{i}", "x", "view", t0 + i) for i in range(40)],
        [("b", "u1", "y", "view", t0 + 100)],
        [("c", "u2", "z", "add_to_cart", t0 + 200), ("d", "u3", "z", "view", t0 + 50_000)],
        [("e", "u1", "q", "view", t0 + 50_100), ("f", "u3", "q", "view", t0 + 50_200)],
    ]
    state = L.session_state(land(spark, str(tmp_path / "in"), files), 1800, delay="60 seconds")
    run = L.to_batches(state, str(tmp_path / "out"), str(tmp_path / "cp"), drain=True)
    assert 0 < run.recentProgress[0].stateOperators[0].numRowsTotal < 10
    got = {(r.batch_id, r.user_id): (r.session_start, r.session_length, r.has_cart_item, r.recent_views) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 45
    assert got[0, "u7"] == (t0 + 7, 1, False, ["x"]) and got[1, "u1"] == (t0 + 1, 2, False, ["y", "x"])
    assert got[2, "u2"] == (t0 + 2, 2, True, ["z", "x"]) and got[2, "u3"] == (t0 + 50_000, 1, False, ["z"])
    assert got[3, "u1"] == (t0 + 50_100, 1, False, ["q"]) and got[3, "u3"] == (t0 + 50_000, 2, False, ["q", "z"])


def test_summaries_of_all_users_of_a_batch_at_once(spark):
    """One pass over a batch of 5,000 users: spans, views chains and newest views of each, and no work per user."""
    import pyarrow as pa

    rows = [(f"u{u:04d}", f"{i:02d}", "a" if i % 2 else ("" if i % 4 else None), "cart" if i == 5 else None, float(i * 100 + (i > 3) * 1000))
            for u in range(5000) for i in range(u % 7 + 1)]
    batch = pa.RecordBatch.from_pydict(dict(zip(("user_id", "event_id", "item_id", "event_type", "timestamp"), zip(*rows))))
    before = time.process_time()
    out = L._summaries(batch, 1000.0, 2, "cart").to_pylist()
    assert time.process_time() - before < 1.0  # a data frame per user took more
    assert [r["user_id"] for r in out] == [f"u{u:04d}" for u in range(5000)]
    one = out[6]
    assert one["pieces"] == [{"a": 0.0, "b": 300.0, "n": 4, "cart": False}, {"a": 1400.0, "b": 1600.0, "n": 3, "cart": True}]
    assert one["chains"] == [{"a": 100.0, "b": 300.0}, {"a": 1500.0, "b": 1500.0}]
    assert one["views"] == [{"t": 300.0, "id": "03", "item": "a"}, {"t": 1500.0, "id": "05", "item": "a"}]
    assert out[0]["chains"] == [] and out[0]["views"] == [] and out[7]["event_time"].timestamp() == 0.0


def test_arrival_state_expires_as_a_whole(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = land(spark, path, [[("1", "u", "a", "view", 1.0), ("2", "u", "b", "add_to_cart", 2.0)]])
    query = L.to_batches(L.session_state(stream, 6, arrival=True), out, str(tmp_path / "cp"), every="1 second")

    def published(rows, seconds=40):
        until = time.time() + seconds
        while time.time() < until:
            time.sleep(1)
            try:
                found = spark.read.parquet(out)
                if found.count() >= rows:
                    return L.latest_state(found).first()
            except Exception:  # nothing written yet, or a batch is being written
                pass
        raise AssertionError("no state was published")

    try:
        first = published(1)
        assert (first.session_length, first.has_cart_item, first.recent_views) == (2, True, ["b", "a"])
        time.sleep(8)
        land(spark, path, [[("3", "u", "c", "view", 3.0)]])
        later = published(2)
        assert (later.session_length, later.has_cart_item, later.recent_views) == (1, False, ["c"])
    finally:
        query.stop()


def test_duplicates_and_closed_sessions(spark, tmp_path):
    t0 = 1.7e9  # not the epoch itself: a stream's first watermark is the epoch, and rows on it are late
    rows = [("1", "u", "a", "view", t0), ("2", "u", "b", "add_to_cart", t0 + 1800), ("3", "u", "c", "view", t0 + 3601), ("4", "v", "c", "view", t0 + 90000)]
    stream = land(spark, str(tmp_path / "in"), [rows[:3] + rows[:1], rows[3:] + rows[3:]])
    L.to_table(L.dedupe(stream), str(tmp_path / "d"), str(tmp_path / "dc"), drain=True)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "d")).collect()) == ["1", "2", "3", "4"]
    once = land(spark, str(tmp_path / "in2"), [rows])
    L.to_table(L.closed_sessions(once), str(tmp_path / "s"), str(tmp_path / "sc"), drain=True)
    got = sorted((r.user_id, r.session_start, r.session_length, r.has_cart_item) for r in spark.read.parquet(str(tmp_path / "s")).collect())
    assert got == [("u", t0, 2, True), ("u", t0 + 3601, 1, False)]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    rows = [("1", "u", "a", "view", 0.0), ("2", "v", "b", "view", 1.0)]
    stream = land(spark, str(tmp_path / "in"), [rows])
    for cp in ("c1", "c2"):  # a second run without the checkpoint replays batch 0
        L.to_batches(stream, str(tmp_path / "out"), str(tmp_path / cp), drain=True, mode="append", shape=L.batch_stats)
    assert [(r.events, r.users) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 2)]


def test_feedback_becomes_events(spark):
    fb = spark.createDataFrame([("u", "i", "click", None, 12.75, None)], "user_id string, item_id string, event_type string, session_id string, received_ts double, context map<string,string>")
    r = M.feedback_events(fb).first()
    assert (r.event_id, r.session_id, r.timestamp, r.metadata) == ("fb-12", "", 12.75, {})
