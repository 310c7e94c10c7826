import os

from clickloom.streaming import snapshots as SN

SHAPE = "user_id string, last_seen double, n long"


def publish(spark, path, batch, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def folders(path, prefix):
    return sorted(f for f in os.listdir(path) if f.startswith(prefix)) if os.path.isdir(path) else []


def test_state_through_snapshots(spark, tmp_path):
    """After every batch the state equals a dictionary's; folders stay bounded; expired users do not come back."""
    path, want, clock, ttl = str(tmp_path / "state"), {}, 0.0, 30.0
    assert SN.current_state(spark, path) is None and SN.compact_state(spark, path) is None
    for batch in range(13):
        rows = [(f"u{(batch * 3 + k) % 17}", batch * 10.0 + k, batch * 100 + k) for k in range(4)]
        if batch == 5:
            rows = []  # an empty batch
        publish(spark, path, batch, rows)
        want |= {u: (t, n) for u, t, n in rows}
        clock = max([clock, *[t for _, t, _ in rows]])
        alive = {u: v for u, v in want.items() if v[0] >= clock - ttl}
        got = {r.user_id: (r.last_seen, r.n) for r in SN.current_state(spark, path, ttl).collect()}
        assert got == alive
        if batch % 3 == 2:
            assert SN.compact_state(spark, path, ttl) == batch
            assert SN.compact_state(spark, path, ttl) is None  # nothing new
            want = alive
            assert {r.user_id: (r.last_seen, r.n) for r in SN.current_state(spark, path).collect()} == want
        assert len(folders(path, "batch_id=")) <= 6 and len(folders(f"{path}/snapshots", "upto=")) <= SN.KEPT_SNAPSHOTS

    # a replayed batch below the snapshot, and a snapshot that was never finished, change nothing
    before = sorted(SN.current_state(spark, path).collect())
    publish(spark, path, 11, [("u1", 999.0, 999)])
    os.makedirs(f"{path}/snapshots/upto=99")
    os.makedirs(f"{path}/batch_id=98")
    assert sorted(SN.current_state(spark, path).collect()) == before
