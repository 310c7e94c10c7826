"""The request log as a stream: one micro-batch per slice, however many files the log has."""

from pyspark.sql import functions as F

from clickloom.operators import telemetry as TM
from clickloom.registry import live_queries as LQ
from clickloom.streaming import live as L


def log_of(spark, parts):
    """A row every 20 minutes of 30 days in `parts` files; the last file has rows of the first days only."""
    n = F.col("id")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.when(n % parts == parts - 1, n % 1000).otherwise(n) * 1200)
    return spark.range(2160).repartition(parts, n % parts).select(
        ts.alias("ts"), F.lit("ok").alias("status"), F.lit("web").alias("device"),
        *[(F.pmod(n * 37, F.lit(900)) / k).alias(f"{s}_ms") for k, s in enumerate(TM.STAGES, 1)],
    )


def with_rows(run):
    return [p for p in run.recentProgress if p.numInputRows]


def test_batches_do_not_grow_with_the_files(spark, tmp_path):
    log = spark.read.parquet(_stored(log_of(spark, 5), tmp_path / "log")).select("ts", *[f"{s}_ms" for s in TM.STAGES])
    out = L.latency_quantiles(LQ.log_stream(spark, log, "slices"), "1 day", "6 hours", delay="10 days")
    run = L.to_table(out, str(tmp_path / "out"), str(tmp_path / "cp"), drain=True)
    assert len(with_rows(run)) == 4
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(TM.latency_quantiles(log, "1 day", "6 hours"))


def test_no_row_is_late_for_its_own_slice(spark, tmp_path):
    """With a delay of a minute, the second file of a slice came too late and its rows were lost."""
    log = spark.read.parquet(_stored(log_of(spark, 3), tmp_path / "log")).select("ts", "status", "device")
    files = LQ.log_slices(spark, log, str(tmp_path / "in"))
    stream = LQ.feeds.folder_stream(spark, str(tmp_path / "in"), files, "ts timestamp, status string, device string")
    L.to_table(L.request_rate(stream, "1 hour", "15 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"), drain=True)
    got = spark.read.parquet(str(tmp_path / "out"))
    end = log.agg(F.unix_micros(F.max("ts")) - 60_000_000).first()[0]
    want = TM.request_rate(log, "1 hour", "15 minutes").where(F.col("window_end_us") <= end)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_event_batches_do_not_grow_with_the_files(spark, tmp_path):
    """A file was a batch of its own, and with a delay of 30 minutes the rows of a slice's second file were lost."""
    n = F.col("id")
    none = F.lit(None).cast("map<string,string>")
    events = spark.range(720).repartition(4, n).select(
        n.cast("string").alias("event_id"), F.concat(F.lit("u"), n % 7).alias("user_id"), F.lit("a").alias("item_id"), F.lit("view").alias("event_type"),
        F.lit("s").alias("session_id"), (1704067200.0 + n * 3600).alias("timestamp"), none.alias("metadata"),
    )
    events = spark.read.parquet(_stored(events, tmp_path / "events"))
    run = L.to_batches(L.session_state(LQ.event_stream(spark, *LQ.landed(spark, events, "slices")), 86400.0), str(tmp_path / "out"), str(tmp_path / "cp"), drain=True)
    assert len(with_rows(run)) == 3
    got = {r.user_id: r.session_length for r in L.latest_state(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    path, files = LQ.slices(spark, events, "timestamp", "live", {"event_id": "~"})
    run = L.to_table(LQ.event_stream(spark, path, files).select("event_id"), str(tmp_path / "live"), str(tmp_path / "live-cp"), drain=True)
    assert len(with_rows(run)) == 4 and spark.read.parquet(str(tmp_path / "live")).count() == 721


def _stored(df, path):
    df.write.parquet(str(path))
    return str(path)
