"""Requests answered from live state, against the batch operator, with messages out of order."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_sessions import EVENT, Store

from clickloom.operators import sessions as E
from clickloom.streaming import live as L
from clickloom.streaming import requests as LR

REQUEST = "request_id string, user_id string, n_recommendations int, request_ts double, context map<string,string>"


def test_session_replays_like_the_store():
    rng = random.Random(1)
    store, own, ts = Store(50.0), LR.Session(50.0, 20), 0.0
    for i in range(600):
        ts += rng.choice([0.0, 1.0, 30.0, 50.0, 51.0])
        item, cart = rng.choice([None, "", "a", "b"]), rng.random() < 0.1
        store.add(str(i), "u", item, "add_to_cart" if cart else "view", ts)
        own.apply(ts, item, cart)
        own = LR.Session(50.0, 20, *own.value())  # as it comes back from the state
        at = ts + rng.choice([0.0, 20.0, 51.0])
        assert own.at(at) == store.get("u", at)


def test_answers_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    base = 1_700_000_000.0
    events = [(f"{i:04d}", f"u{rng.randint(0, 4)}", rng.choice([None, "", "a", "b", "c"]), rng.choice(["view", "add_to_cart"]), base + rng.randint(0, 9000), "s") for i in range(400)]
    asked = [(f"r{k:03d}", f"u{rng.randint(0, 5)}", rng.choice([None, 7]), base + rng.randint(0, 9500), rng.choice([None, {"device": "mobile"}])) for k in range(120)]
    asked.append(("at", events[0][1], 5, events[0][4], None))
    late = [("~", "~", None, "~", base + 90_000, "s")]
    lost = [("x", None, "a", "view", base, "s"), ("y", "u1", "a", "view", None, "s")]

    def order(rows, ts):  # three files, each row up to two of them too late
        rows = sorted(rows, key=lambda r: (r[ts] or base) + rng.randint(0, 2500))
        return [rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3] for i in range(3)]

    for name, rows, schema, ts, beat in (("e", events + lost, EVENT, 4, late), ("r", asked, REQUEST, 3, [("~", "~", 1, base + 90_000, None)])):
        for part in [*order(rows, ts), beat]:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    out = LR.answers([stream("e", EVENT)], stream("r", REQUEST), 300.0, delay="2 hours")
    L.to_table(out.where("user_id <> '~'"), str(tmp_path / "out"), str(tmp_path / "cp"), drain=True)
    got = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = E.state_at(spark.createDataFrame(asked, REQUEST), spark.createDataFrame(events, EVENT), 300.0).collect()
    assert len(got) == len(want) == len(asked)
    known = {a[0]: a for a in asked}
    for w in want:
        g = got[w.request_id]
        assert (g.session_length, g.has_cart_item, list(g.recent_views)) == (w.session_length, w.has_cart_item, w.recent_views)
        assert g.session_age_seconds == pytest.approx(w.session_age_seconds) and g.last_seen_timestamp == w.last_seen_timestamp
        assert (g.n_recommendations, g.context) == (known[g.request_id][2], known[g.request_id][4])


def test_users_of_a_bucket_share_the_calls():
    """Every user had calls, a timer and a data frame of its own."""
    calls = []

    class Store:
        held, timers = None, []

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            calls.append("clear")
            self.held = None

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers = [*self.timers, at]

        def deleteTimer(self, at):
            self.timers = [t for t in self.timers if t != at]

    class At:
        def __init__(self, seconds):
            self.getCurrentWatermarkInMs = lambda: int(seconds * 1000)

    store = Store()
    live = LR.LiveRequests(50.0, 20)
    live._state = live._handle = store
    rows = [(f"u{u:02d}", 100.0 + u + k, k % 2, f"{k}", "a" if k % 2 == 0 else None, False, 5 if k % 2 else None, None) for u in range(30) for k in range(4)]
    frame = pd.DataFrame(rows, columns=["user_id", *LR.FIELDS])
    assert list(live.handleInputRows((1,), iter([frame]), At(0))) == [] and store.timers == [100_001]
    (out,) = live.handleExpiredTimer((1,), At(110.0), None)
    want = {}
    for user, ts, kind, *rest in rows:
        session = want.setdefault(user, LR.Session(50.0, 20))
        if kind and ts <= 110.0:
            assert tuple(out[(out.user_id == user) & (out.request_ts == ts)].iloc[0][["session_length", "session_age_seconds"]]) == session.at(ts)[:2]
        elif not kind:
            session.apply(ts, rest[1], False)
    assert len(out) == sum(r[2] == 1 and r[1] <= 110.0 for r in rows) and store.timers == [111_001]
    (out,) = live.handleExpiredTimer((1,), At(150.0), None)
    assert len(out) == sum(r[2] == 1 and r[1] > 110.0 for r in rows) and not store.held[0] and len(store.held[1]) == 30
    assert list(live.handleExpiredTimer((1,), At(500.0), None)) == [] and store.held is None and store.timers == []
    assert calls == ["get", "update"] * 3 + ["get", "clear"]


def test_messages_that_are_no_requests_are_left_out(spark):
    rows = [('{"request_id":"a","user_id":"u","request_ts":5.0}',), ('{"request_id":"b","request_ts":5.0}',), ("{broken",), (None,)]
    messages = spark.createDataFrame(rows, "value string")
    assert [r.request_id for r in LR.parse_requests(messages).collect()] == ["a"]
    posts = spark.createDataFrame([('{"user_id":"u","item_id":"i","event_type":"purchase","received_ts":7.9}',), ('{"item_id":"i"}',)], "value string")
    (post,) = LR.parse_feedback(posts).collect()
    assert (post.event_id, post.timestamp, post.session_id) == ("fb-7", 7.9, "")


def test_events_without_user_or_time_do_not_stop_the_state(spark):
    rows = [("1", "u", "a", "view", 10.0, "s"), ("2", "u", "a", "view", None, "s"), ("3", None, "a", "view", 5.0, "s"), ("4", "u", "a", "view", float("nan"), "s")]
    (summary,) = L.compact(spark.createDataFrame(rows, EVENT).coalesce(1)).collect()
    assert summary.user_id == "u" and summary.pieces[0].n == 1
    messages = spark.createDataFrame(rows, EVENT).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    from clickloom.operators import messages as M

    assert L.parse(M.encode_events(messages)).where("not ok").count() == 3
