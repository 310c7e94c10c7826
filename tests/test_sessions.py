import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import sessions as E
from clickloom.operators.timeline import session_runs

EVENT = "event_id string, user_id string, item_id string, event_type string, timestamp double, session_id string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], EVENT)


class Store:
    """Replays events one by one, the way a key-value session store with life times would."""

    def __init__(self, ttl):
        self.ttl, self.s, self.v = ttl, {}, {}

    def add(self, eid, user, item, kind, ts):
        s = self.s.get(user)
        if not s or ts - s["last"] > self.ttl:
            s = self.s[user] = {"start": ts, "n": 0, "cart": False}
        s["n"] += 1
        s["last"] = ts
        s["cart"] |= kind == "add_to_cart"
        if item:
            v = self.v.get(user)
            if not v or ts - v["last"] > self.ttl:
                v = self.v[user] = {"items": []}
            v["items"] = ([item] + v["items"])[:20]
            v["last"] = ts

    def get(self, user, ts):
        s, v = self.s.get(user), self.v.get(user)
        s = s if s and ts - s["last"] <= self.ttl else None
        v = v if v and ts - v["last"] <= self.ttl else None
        return (
            s["n"] if s else 0,
            ts - s["start"] if s else 0.0,
            s["last"] if s else ts,
            s["cart"] if s else False,
            v["items"] if v else [],
        )


def random_events(seed, n=600, users=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.4 else f"u{rng.randint(1, users)}"
        kind = rng.choice(["view", "view", "search", "add_to_cart", "purchase"])
        item = None if kind == "search" else rng.choice(["", f"i{rng.randint(0, 9)}", f"i{rng.randint(0, 9)}"])
        rows.append((f"{i:05d}", user, item, kind, float(rng.randint(0, 40000) * 5)))
    return rows


@pytest.mark.parametrize("bucket", [500, 7000, 10**9])
def test_running_sessions_do_not_depend_on_the_bucket(spark, bucket):
    rows = random_events(3)
    run = session_runs(
        make(spark, rows), 1800, flag=F.col("event_type") == "add_to_cart", previous=("event_type",), bucket_seconds=bucket
    )
    got = {r.event_id: r for r in run.collect()}
    assert len(got) == len(rows)
    prev, state = {}, {}
    for eid, user, item, kind, ts in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        p = prev.get(user)
        new = p is None or ts - p[0] > 1800
        if new:
            old = state.get(user, (0, 0, 0, 0, False))
            state[user] = (old[0] + 1, ts, 0, old[3], False)
        no, start, n, pos, cart = state[user]
        state[user] = (no, start, n + 1, pos + 1, cart or kind == "add_to_cart")
        no, start, n, pos, cart = state[user]
        r = got[eid]
        assert (r.session_no, r.session_start, r.n_so_far, r.pos, r.flag_so_far) == (no, start, n, pos, cart)
        assert (r.prev_ts, r.prev_event_type, r.is_start) == ((p[0], p[1], new) if p else (None, None, True))
        prev[user] = (ts, kind)


def test_gap_equal_to_the_ttl_stays_in_the_session(spark):
    rows = [("1", "u", "a", "view", 0.0), ("2", "u", "b", "view", 1800.0), ("3", "u", "c", "view", 3601.0)]
    got = {r.event_id: r.session_no for r in E.runs(make(spark, rows)).collect()}
    assert got == {"1": 1, "2": 1, "3": 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_at_equals_a_replayed_store(spark, seed):
    events = random_events(seed)
    rng = random.Random(seed + 100)
    requests = [(f"r{i}", rng.choice(["hot", "u1", "u2", "u3", "nobody"]), float(rng.randint(0, 210000))) for i in range(200)]
    requests += [("same", events[0][1], events[0][4])]
    got = {
        r.request_id: (r.session_length, r.session_age_seconds, r.last_seen_timestamp, r.has_cart_item, r.recent_views)
        for r in E.state_at(spark.createDataFrame(requests, "request_id string, user_id string, request_ts double"), make(spark, events)).collect()
    }
    assert len(got) == len(requests)
    for rid, user, at in requests:
        store = Store(1800)
        for e in sorted((e for e in events if e[1] == user and e[4] <= at), key=lambda e: (e[4], e[0])):
            store.add(*e)
        assert got[rid] == store.get(user, at), rid


def test_views_are_capped_at_twenty_and_newest_first(spark):
    rows = [(f"{i:02d}", "u", f"i{i}", "view", float(i)) for i in range(25)] + [("99", "u", None, "search", 30.0)]
    views = E.recent_views(E.view_runs(make(spark, rows))).orderBy("view_rank").collect()
    assert [v.item_id for v in views] == [f"i{i}" for i in range(24, 4, -1)]
    lists = E.view_lists(E.recent_views(E.view_runs(make(spark, rows)))).first()
    assert lists.recent_views[:2] == ["i24", "i23"]


def test_views_expire_while_the_session_lives(spark):
    rows = [("1", "u", "a", "view", 0.0), ("2", "u", None, "search", 1500.0), ("3", "u", None, "search", 3000.0)]
    req = spark.createDataFrame([("r", "u", 3100.0)], "request_id string, user_id string, request_ts double")
    got = E.state_at(req, make(spark, rows)).first()
    assert got.session_length == 3 and got.session_age_seconds == 3100.0 and got.recent_views == []


def test_transition_shares_add_up(spark):
    rows = random_events(5)
    out = E.transitions(make(spark, rows)).collect()
    sums = {}
    for r in out:
        sums[r.state] = sums.get(r.state, 0) + r.share
    assert all(v == pytest.approx(1.0) for v in sums.values())
    assert sum(r.n for r in out if r.state == "start") == sum(r.n for r in out if r.next_state == "end")


def test_session_ids_of_two_users_are_found(spark):
    rows = [("1", "u", None, "view", 0.0), ("2", "v", None, "view", 0.0)]
    assert E.session_integrity(make(spark, rows)).first().users == 2
