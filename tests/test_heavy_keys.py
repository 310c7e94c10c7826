"""Timelines of users with very many events in little time, against the replayed store."""

import random

import pytest
from pyspark.sql import functions as F
from test_sessions import Store, make

from clickloom.operators import sessions as E
from clickloom.operators import timeline as TL

HEAVY = 60


def crowded(seed, n=1500):
    """A third of all events belong to one user inside one hour, many of them in one second."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.35
        ts = 50_000.0 + rng.choice([rng.randint(0, 3599), 1800]) if hot else float(rng.randint(0, 200_000))
        rows.append((f"{i:05d}", "hot" if hot else f"u{rng.randint(1, 9)}", rng.choice([None, "", "i1", "i2", "i3"]), rng.choice(["view", "add_to_cart"]), ts))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_state_at_with_heavy_keys(spark, monkeypatch, seed):
    monkeypatch.setattr(TL, "HEAVY_ROWS", HEAVY)
    rows, ttl = crowded(seed), 400.0
    rng = random.Random(seed)
    asked = [(f"r{k:04d}", rng.choice(["hot", "hot", "u1", "u2", "nobody"]), float(rng.choice([rng.randint(50_000, 53_700), 51_800, rng.randint(0, 200_000)]))) for k in range(400)]
    store, want = Store(ttl), {}
    both = [(r[4], 0, r[0], r) for r in rows] + [(t, 1, i, (i, u, t)) for i, u, t in asked]
    for _, kind, _, r in sorted(both, key=lambda x: x[:3]):
        if kind:
            want[r[0]] = store.get(r[1], r[2])
        else:
            store.add(*r)
    requests = spark.createDataFrame(asked, "request_id string, user_id string, request_ts double")
    got = E.state_at(requests, make(spark, rows), ttl).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.session_length, r.session_age_seconds, r.last_seen_timestamp, r.has_cart_item, r.recent_views) == want[r.request_id]


def test_runs_do_not_depend_on_the_pieces(spark):
    rows = crowded(3) + [(f"n{k:03d}", None, "i1", "view", None) for k in range(300)] + [("same", "hot", "i1", "view", 51_800.0)] * 200
    events = make(spark, rows)
    cols = ["event_id", "user_id", "pos", "session_no", "session_start", "start_pos", "n_so_far", "flag_so_far", "prev_ts", "is_start"]
    whole = TL.session_runs(events, 300.0, flag=F.col("event_type") == "add_to_cart", heavy_rows=10**9)
    cut = TL.session_runs(events, 300.0, flag=F.col("event_type") == "add_to_cart", heavy_rows=HEAVY)
    key = lambda r: tuple(map(str, r))
    # rows without time tie, and so do equal rows: their places are compared without their names
    part = lambda df: sorted(key(r) for r in df.where("event_id not like 'n%'").select(*cols).collect())
    assert part(whole) == part(cut)
    lost = lambda df: sorted(r.pos for r in df.where("event_id like 'n%'").collect())
    assert lost(whole) == lost(cut) == list(range(1, 301))


def test_pieces_are_of_even_size_and_in_order(spark):
    rows = make(spark, crowded(4)).withColumn("_b", F.floor(F.col("timestamp") / TL.BUCKET_SECONDS))
    got = TL.spread(rows, "user_id", ["timestamp", "event_id"], HEAVY).where("_p > 0 or user_id = 'hot'")
    pieces = got.groupBy("user_id", "_b", "_p").agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "event_id")).alias("a"), F.max(F.struct("timestamp", "event_id")).alias("z")).collect()
    hot = sorted((p for p in pieces if p.user_id == "hot"), key=lambda p: p._p)
    assert len(hot) > 5 and max(p.n for p in hot) < 3 * HEAVY
    assert all(x.z < y.a for x, y in zip(hot, hot[1:]))
